"""Keyed state over a feed: toggle edges, and upserts that remember the order of arrival, by ``transformWithState``.

A key's state is its last change. A micro-batch brings a key's changes together (as many as one batch holds of it), in the order of time
and event id; changes that aren't later than the state are late and count for nothing. State is kept in RocksDB, in the stream's
checkpoint, so a stream that starts again goes on; results are written by batch number, so a batch that is run again replaces its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.upsert import upserted
from tessera.streaming.versioned import VersionedTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EDGES = "id long, event_id long, action string"
ROWS = "id long, event_id long, event_type string, value double, arrived_micros long, arrived_event long"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; what was there before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class InOrder(StatefulProcessor):
    """Gives a key's changes of a batch in order, without late ones; ``step`` makes of them the rows that go out."""

    state, out = "", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", f"micros long, event_id long, {self.state}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = sorted(rows, key=lambda r: (r["micros"], r["event_id"]))
        micros, event, *rest = self.held.get() if self.held.exists() else (None, None, *[None] * len(self.state.split(",")))
        out, last = [], (micros, event)
        for row in found:
            if micros is None or (row["micros"], row["event_id"]) > (micros, event):
                rest, given = self.step(key[0], row, rest)
                out += given
                micros, event = row["micros"], row["event_id"]
        if (micros, event) != last:
            self.held.update((micros, event, *rest))
        return self.given(out)

    def given(self, out: list[tuple]) -> Iterator[Row]:
        return (Row(**dict(zip(self.names, row))) for row in out)

    @property
    def names(self) -> list[str]:
        return [c.split()[0] for c in self.out.split(", ")]

    def step(self, key, row: Row, rest: list) -> tuple[list, list]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Toggles(InOrder):
    """A row where the flag differs from the key's one before; the first counts if it is on."""

    state, out = "flag boolean", EDGES

    def step(self, key, row, rest):
        flag = bool(row["flag"])
        return [flag], [(key, row["event_id"], "publish" if flag else "retract")] * (flag != bool(rest[0]))


class Arrivals(InOrder):
    """The change itself, with the place of the key's first one; only the last of a batch matters, as it replaces the others."""

    state, out = "arrived_micros long, arrived_event long", ROWS

    def step(self, key, row, rest):
        first = [int(row["micros"]), int(row["event_id"])] if rest[0] is None else rest
        return first, [(key, row["event_id"], row["event_type"], row["value"], *first)]

    def given(self, out):
        return super().given(out[-1:])


def kept_state(changes: DataFrame, processor: InOrder) -> DataFrame:
    """A stream of what a processor gives for changes (id, event_id, ts and others)."""
    at = changes.where("id is not null and event_id is not null and ts is not null").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    return at.groupBy("id").transformWithState(processor, processor.out, "Append", "None")


def run(stream: DataFrame, each, place: str, partitions: int | None) -> None:
    """Run a stream over what is there. ``partitions``: of the state, fixed when it first starts; by default the session's."""
    spark = stream.sparkSession
    more = {} if partitions is None else {"spark.sql.shuffle.partitions": str(partitions)}
    with settings(spark, {"spark.sql.streaming.stateStore.providerClass": ROCKS} | more):
        query = stream.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()


def toggle_edges(log: DataFrame, place: str, partitions: int | None = None) -> DataFrame:
    """id, event_id, action: the edges of a stream of flags (id, event_id, ts, flag), of this run and those before it at this place."""
    run(kept_state(log, Toggles()), lambda batch, number: batch.write.mode("overwrite").parquet(f"{place}/edges/batch={number}"), place, partitions)
    try:
        return log.sparkSession.read.schema(EDGES).parquet(f"{place}/edges").select("id", "event_id", "action")
    except AnalysisException as missing:  # no batch at all
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return log.sparkSession.createDataFrame([], EDGES)


def arrival_snapshot(changes: DataFrame, place: str, partitions: int | None = None) -> DataFrame:
    """The newest change of each id and the place of its first one (arrived_micros, arrived_event): a list in which changes replace in place, and new ids are appended."""
    table = VersionedTable(changes.sparkSession, f"{place}/snapshot")

    def merge(batch: DataFrame, number: int) -> None:
        now = table.version()
        if now is not None and int(now.marks["batch"]) >= number:
            return
        own = batch.persist()
        if now is None:
            table.create(own, "id", marks={"batch": str(number)})
        else:
            table.rewrite(own, lambda old, new: upserted(old, new, "id"), {"batch": str(number)})
            table.vacuum()
        own.unpersist()

    run(kept_state(changes, Arrivals()), merge, place, partitions)
    return changes.sparkSession.createDataFrame([], ROWS) if table.version() is None else table.read()
