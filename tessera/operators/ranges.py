"""Order without one partition: rows are dealt into ranges of a key of nearly equal counts, whatever the keys look like."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 64  #: sampled rows for each range


def split_points(rows: DataFrame, key: str, n: int) -> list:
    """At most n - 1 values of key that cut it into ranges of nearly equal counts.

    They come from ``SAMPLE`` rows for each range, those with the smallest hashes, so the same rows give the same points.
    """
    some = sorted(r[0] for r in rows.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(n * SAMPLE).collect())
    return sorted({some[k * len(some) // n] for k in range(1, n)}) if some else []


def range_number(key: Column, points: list) -> Column:
    """How many of the points are at most the key, found in two steps of the root of their number; nulls are in range 0."""
    if not points:
        return F.lit(0)
    step = max(1, int(len(points) ** 0.5))
    groups = [points[k : k + step] for k in range(0, len(points), step)]
    fine = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    coarse = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), lambda x: x <= key))  # groups that begin at or before the key
    last = F.size(F.filter(F.get(fine, coarse - 1), lambda x: x <= key))
    return F.when(coarse > 0, (coarse - 1) * step + last).otherwise(0).cast("int")


def ranged(rows: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """rows with ``range``: n of them, by default as many as a shuffle has partitions."""
    n = n or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("range", range_number(F.col(key), split_points(rows, key, n)))


def ranked(rows: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """rows with ``rank``, the place of each in the order of key (from 0; keys are distinct).

    One small row for each range goes over the driver.
    """
    dealt = ranged(rows, key, n)
    counts = sorted(dealt.groupBy("range").agg(F.count("*").alias("n")).collect())
    starts = rows.sparkSession.createDataFrame(list(zip([r["range"] for r in counts], accumulate([r["n"] for r in counts], initial=0))), "range int, _before long")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1
    return dealt.withColumn("_inside", inside).join(F.broadcast(starts), "range").withColumn("rank", F.col("_before") + F.col("_inside")).drop("range", "_before", "_inside")
