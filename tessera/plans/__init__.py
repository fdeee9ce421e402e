"""Registered queries and their SQL."""

from tessera.plans import applied  # noqa: F401  (registers its queries)
