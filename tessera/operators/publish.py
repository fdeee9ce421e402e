"""Publishing names as set-valued labels: the plan, its batches under a row budget, and the difference to what stands."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import trimmed
from tessera.operators.ranges import ranged
from tessera.sources.places import written

MOST_BYTES, MOST_VALUES, MOST_ROWS = 128, 32, 2000
RANGE_ROWS = 100_000  #: writes that one task follows


def publish_plan(faces: DataFrame, people: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """record_id, key, values: for each record its names (sorted, the first 32) and the number of its faces.

    ``processed`` (record_id): further records; those without faces get two empty sets.
    """
    name = trimmed(F.col("name"))
    named = people.select("person_id", F.when((F.octet_length(name) <= MOST_BYTES) & (name != ""), name).alias("name"))
    joined = faces.select("record_id", "person_id").join(named, "person_id", "left")
    own = joined.groupBy("record_id").agg(F.slice(F.array_sort(F.collect_set("name")), 1, MOST_VALUES).alias("names"), F.array(F.count("*").cast("string")).alias("counts"))
    if processed is not None:
        none = F.array().cast("array<string>")
        own = own.join(processed.select("record_id").distinct(), "record_id", "full_outer").select("record_id", F.coalesce("names", none).alias("names"), F.coalesce("counts", none).alias("counts"))
    return own.select("record_id", F.expr("stack(2, 'faceCount', counts, 'faces', names) as (key, values)"))


def retract_plan(faces: DataFrame) -> DataFrame:
    """Empty sets for both keys of every processed record."""
    return faces.select("record_id").distinct().select("record_id", F.explode(F.array(F.lit("faceCount"), F.lit("faces"))).alias("key"), F.array().cast("array<string>").alias("values"))


def next_fit(costs: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For every possible filling 0..budget of the open batch at the start: batches closed and filling at the end."""
    fill, closed = np.arange(budget + 1), np.zeros(budget + 1, np.int64)
    group = np.arange(budget + 1)  # fillings that have become equal move on as one
    offset = np.zeros(budget + 1, np.int64)
    for c in costs.tolist():
        full = (fill > 0) & (fill + c > budget)
        closed += full
        fill = np.where(full, c, fill + c)
        if len(fill) > 1:
            fill_, at, back = np.unique(fill, return_index=True, return_inverse=True)
            if len(fill_) < len(fill):
                offset += (closed - closed[at][back])[group]
                group, fill, closed = back[group], fill_, closed[at]
    return closed[group] + offset, fill[group]


def batched(plan: DataFrame, budget: int = MOST_ROWS, ranges: int | None = None) -> DataFrame:
    """plan with ``batch`` (from 0): next-fit by record_id and key; a write costs its values, at least 1. The plan is computed once, and written.

    A batch closes when the next write doesn't fit; a write over the budget has a batch of its own. Ranges of record ids
    of about ``RANGE_ROWS`` writes are followed for every filling they may start with. What such a range does to a filling
    is constant over runs of fillings, of which few are left after some writes; these runs are chained, range by range.
    """
    plan = written(plan, "plan")
    ranges = ranges or max(1, -(-plan.count() // RANGE_ROWS))
    slim = ranged(plan.select("record_id", "key", F.greatest(F.lit(1), F.size("values")).alias("cost")), "record_id", ranges)

    def followed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["record_id", "key"])
        closed, fill = next_fit(frame["cost"].to_numpy(), budget)
        begins = np.flatnonzero(np.append(True, (np.diff(closed) != 0) | (np.diff(fill) != 0)))
        return pd.DataFrame({"range": frame["range"].iloc[0], "from": begins, "closed": closed[begins], "fill": fill[begins]})

    def placed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["record_id", "key"])
        batch, fill, out = int(frame["done"].iloc[0]), int(frame["held"].iloc[0]), []
        for c in frame["cost"].tolist():
            if fill > 0 and fill + c > budget:
                batch, fill = batch + 1, 0
            out.append(batch)
            fill += c
        return pd.DataFrame({"record_id": frame["record_id"], "key": frame["key"], "batch": out})

    # a few runs for each range
    runs = sorted(slim.groupBy("range").applyInPandas(followed, "range int, from int, closed long, fill long").collect())
    starts, done, held = [], 0, 0
    for number, own in groupby(runs, key=lambda r: r["range"]):
        starts.append((number, done, held))
        last = [r for r in own if r["from"] <= min(held, budget)][-1]
        done, held = done + last["closed"], last["fill"]
    begin = F.broadcast(plan.sparkSession.createDataFrame(starts, "range int, done long, held long"))
    numbered = slim.join(begin, "range").groupBy("range").applyInPandas(placed, "record_id string, key string, batch long")
    return plan.join(numbered, ["record_id", "key"])


def set_difference(desired: DataFrame, standing: DataFrame) -> DataFrame:
    """record_id, key, value, op: what to insert, keep and tombstone so that exactly the desired values stand.

    desired: record_id, key, values; standing: record_id, key, value. Only keys that are desired (also as
    empty sets) are touched.
    """
    wanted = desired.select("record_id", "key", F.explode("values").alias("value")).distinct().withColumn("_w", F.lit(True))
    touched = desired.select("record_id", "key").distinct()
    there = standing.select("record_id", "key", "value").distinct().join(touched, ["record_id", "key"], "left_semi").withColumn("_t", F.lit(True))
    op = F.when(F.col("_t").isNull(), "insert").when(F.col("_w").isNull(), "tombstone").otherwise("keep")
    return wanted.join(there, ["record_id", "key", "value"], "full_outer").select("record_id", "key", "value", op.alias("op"))


def publish_summary(plan: DataFrame, batches: DataFrame) -> DataFrame:
    """One row: records written, with faces, names and batches."""
    whole = plan.agg(F.count("*").alias("records_written"), F.count_if((F.col("key") == "faceCount") & (F.size("values") > 0)).alias("images_with_faces"))
    names = plan.where("key = 'faces'").select(F.explode("values").alias("name")).agg(F.countDistinct("name").alias("names_published"))
    return whole.crossJoin(names).crossJoin(batches.agg(F.coalesce(F.max("batch") + 1, F.lit(0)).alias("batches")))  # one row each
