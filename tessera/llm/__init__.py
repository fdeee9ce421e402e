"""Operators for preparing language-model training data, as Spark jobs.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
