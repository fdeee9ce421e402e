"""Keeping a snapshot fresh from a feed of changes, by Structured Streaming or by a stored cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.upsert import latest
from tessera.sources.places import folder  # noqa: F401  (callers find it here too)
from tessera.streaming.versioned import BUCKET_ROWS, VersionedTable, buckets_for


def change_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a table of changes: one Parquet file or a folder of them (a pattern stands for either)."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def newest(changes: DataFrame) -> DataFrame:
    """The newest change of each id."""
    return latest(changes, "id", [F.desc("ts"), F.desc("event_id")])


def fresh_snapshot(changes: DataFrame, place: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Run the stream over what is there; each micro-batch is merged into the buckets of the snapshot that it touches.

    The snapshot is a versioned table, and the batch's number is committed with its rows; so a batch that is run again is left
    out, and a reader sees whole batches. The first batch tells how many buckets there are.
    """
    table = VersionedTable(changes.sparkSession, f"{place}/snapshot")

    def merge(batch: DataFrame, number: int) -> None:
        now = table.version()
        if now is not None and int(now.marks["batch"]) >= number:
            return
        own = batch.persist()
        marks = {"batch": str(number)}
        if now is None:
            table.create(newest(own), "id", buckets_for(own.count(), bucket_rows), marks)
        else:
            table.rewrite(own, lambda old, new: newest(old.unionByName(new)), marks)
            table.vacuum()
        own.unpersist()

    query = changes.writeStream.foreachBatch(merge).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return changes.sparkSession.createDataFrame([], changes.schema) if table.version() is None else table.read()


def since(changes: DataFrame, cursor: str | None, time: str = "ts") -> DataFrame:
    """Changes after a cursor (exclusive); all for none."""
    return changes if not cursor else changes.where(F.col(time) > F.lit(cursor).cast(changes.schema[time].dataType))


def synced(table: VersionedTable, changes: DataFrame, time: str = "ts", buckets: int | None = None) -> int:
    """Bring a table (by id) up to a feed of changes: those after the cursor that its version holds, all if it has none yet.

    However many changes there are, they are one version with their rows and their cursor, so a failure before the commit leaves both as they
    were. The cursor only ever rises; without later changes nothing is written. Gives how many changes were read.
    """
    now = table.version()
    fresh = since(changes, now.marks.get("cursor") if now else None, time).persist()
    n, last = fresh.agg(F.count("*"), F.max(time).cast("string")).first()
    if n and now is None:
        table.create(newest(fresh), "id", buckets, {"cursor": last})
    elif n and last is not None:
        table.rewrite(fresh, lambda old, new: newest(old.unionByName(new)), {"cursor": last})
    fresh.unpersist()
    return n


def windowed_counts(changes: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Changes by window and kind; works on streams, where later changes than ``late`` are left out."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def toggles(log: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows where a flag differs from the key's one before (the first counts if it is on), with what to do."""
    before = F.lag(flag, 1, False).over(Window.partitionBy(key).orderBy("ts", "event_id"))
    return log.withColumn("_b", before).where(F.col(flag) != F.col("_b")).withColumn("action", F.when(F.col(flag), "publish").otherwise("retract")).drop("_b")
