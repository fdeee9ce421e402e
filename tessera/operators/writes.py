"""Writes that are applied to a versioned table: exact value sets, patches and deletions, each as one new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.operators.observed import counted
from tessera.operators.publish import set_difference
from tessera.operators.upsert import patched
from tessera.sources.places import written
from tessera.streaming.versioned import VersionedTable

OPS = ("insert", "keep", "tombstone")


def set_values(labels: VersionedTable, desired: DataFrame) -> dict[str, int]:
    """Let exactly the desired values (record_id, key, values) stand for the keys that are desired; other keys aren't touched.

    labels is a table of record_id, key, value by record_id. Gives how many values were inserted, kept and taken away; they are
    counted while the rows are written, so nothing is read for it again.
    """
    seen, counts = Observation("values"), [F.count_if(F.col("op") == o).alias(o) for o in OPS]
    desired = written(desired.select("record_id", "key", "values"), "desired")  # a plan is computed once
    if not desired.limit(1).count():
        return dict.fromkeys(OPS, 0)

    def merge(old: DataFrame, desired: DataFrame) -> DataFrame:
        ops = set_difference(desired, old).observe(seen, *counts)
        others = old.join(desired.select("record_id", "key").distinct(), ["record_id", "key"], "left_anti")
        return others.unionByName(ops.where("op <> 'tombstone'").drop("op"))

    number = labels.rewrite(desired, merge).number
    got = counted(seen, set_difference(desired, labels.read(number - 1)), counts)
    return {o: got[o] for o in OPS}


def apply_patches(table: VersionedTable, patches: DataFrame, columns: list[str]) -> None:
    """Partial upserts by the table's key: see ``patched``."""
    table.rewrite(patches, lambda old, new: patched(old, new, table.version().key, columns))


def apply_deletes(table: VersionedTable, ids: DataFrame) -> int:
    """Rows of the ids (one column, named like the table's key) go; gives how many went."""
    seen, counts = Observation("gone"), [F.count_if(F.col("_gone")).alias("n")]
    if not ids.limit(1).count():
        return 0
    key = ids.columns[0]

    def marked(old: DataFrame, ids: DataFrame) -> DataFrame:
        return old.join(ids.distinct().withColumn("_gone", F.lit(True)), key, "left")

    number = table.rewrite(ids, lambda old, ids: marked(old, ids).observe(seen, *counts).where("_gone is null")).number
    return counted(seen, marked(table.read(number - 1), ids), counts)["n"]
