"""Counters that are observed while rows are written."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation


def counted(observation: Observation, rows: DataFrame, counts: list[Column]) -> dict[str, int]:
    """What was observed; where nothing was left to write, Spark drops the plan with its counters, and rows are counted for themselves."""
    try:
        return observation.get
    except Py4JJavaError:
        return rows.agg(*counts).first().asDict()
