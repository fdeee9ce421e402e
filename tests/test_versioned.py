"""Applied writes: versions are whole, writers that die or come second change nothing, cursors come with their rows."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tessera.operators import writes
from tessera.streaming import freshness
from tessera.streaming.versioned import Conflict, VersionedTable, buckets_for

LABELS = "record_id string, key string, value string"
SETS = "record_id string, key string, values array<string>"


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}/table"


def labels_of(table, number=None):
    return {tuple(r) for r in table.read(number).select("record_id", "key", "value").collect()}


def test_publish_rename_retract(spark, place):
    rng = random.Random(3)
    state = {(f"r{rng.randrange(30)}", rng.choice("ab"), str(rng.randrange(4))) for _ in range(60)} | {("mine", "k", "v")}
    table = VersionedTable(spark, place)
    table.create(spark.createDataFrame(sorted(state), LABELS), "record_id", 5)
    for _ in range(4):
        sets = {(f"r{rng.randrange(40)}", rng.choice("ab")): sorted({str(rng.randrange(4)) for _ in range(rng.randrange(4))}) for _ in range(15)}
        before = {x for x in state if x[:2] in sets}
        after = {(*k, v) for k, vs in sets.items() for v in vs}
        got = writes.set_values(table, spark.createDataFrame([(*k, v) for k, v in sets.items()], SETS))
        state = state - before | after
        assert labels_of(table) == state
        assert got == {"insert": len(after - before), "keep": len(after & before), "tombstone": len(before - after)}
    assert writes.set_values(table, spark.createDataFrame([], SETS)) == {"insert": 0, "keep": 0, "tombstone": 0}
    assert len(table.numbers()) == 5 and ("mine", "k", "v") in state


def test_a_rename_leaves_no_old_name(spark, place):
    table = VersionedTable(spark, place)
    table.create(spark.createDataFrame([("r", "faces", "Alice"), ("r", "faces", "Bob"), ("s", "faces", "Alice")], LABELS), "record_id", 2)
    writes.set_values(table, spark.createDataFrame([("r", "faces", ["Alicia", "Bob"])], SETS))
    assert labels_of(table) == {("r", "faces", "Alicia"), ("r", "faces", "Bob"), ("s", "faces", "Alice")}


def test_only_touched_buckets_are_written(spark, place):
    table = VersionedTable(spark, place)
    table.create(spark.range(100).select("id", F.lit(0).alias("x")), "id", 10)
    before = table.version().folders
    table.rewrite(spark.createDataFrame([(5, 1)], "id long, x int"), lambda old, new: old.join(new, "id", "left_anti").unionByName(new))
    after = table.version().folders
    assert sum(before[b] != after[b] for b in before) == 1 and table.read().count() == 100
    assert table.read(1).where("x = 1").count() == 0 and table.read(2).where("x = 1").count() == 1


def test_a_dead_writer_leaves_the_old_state(spark, place, monkeypatch):
    table = VersionedTable(spark, place)
    table.create(spark.createDataFrame([("r", "k", "1")], LABELS), "record_id", 2)

    def dies(old, new):
        fail = F.udf(lambda x: 1 / 0, "string")
        return old.withColumn("value", fail("value"))

    with pytest.raises(Exception):
        table.rewrite(spark.createDataFrame([("r", "k", "2")], LABELS), dies)
    assert labels_of(table) == {("r", "k", "1")} and table.numbers() == [1]

    def never(self, version):
        raise OSError("killed before the manifest")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "commit", never)
        with pytest.raises(OSError):
            writes.set_values(table, spark.createDataFrame([("r", "k", ["3"])], SETS))
    assert labels_of(VersionedTable(spark, place)) == {("r", "k", "1")}
    writes.set_values(table, spark.createDataFrame([("r", "k", ["4"])], SETS))
    table.vacuum(1)
    assert labels_of(table) == {("r", "k", "4")}
    folders = set(os.listdir(f"{place.removeprefix('file://')}/data")) - {".crc"}
    assert folders == set(table.version().folders.values())  # what the dead ones wrote is gone


def test_the_second_of_two_writers_gets_a_conflict(spark, place):
    table, other = VersionedTable(spark, place), VersionedTable(spark, place)
    table.create(spark.createDataFrame([("r", "k", "1")], LABELS), "record_id", 2)

    def late(old, new):  # another writer is quicker
        writes.set_values(other, spark.createDataFrame([("r", "k", ["quick"])], SETS))
        return new

    with pytest.raises(Conflict):
        table.rewrite(spark.createDataFrame([("r", "k", "slow")], LABELS), late)
    assert labels_of(table) == {("r", "k", "quick")}
    with pytest.raises(Conflict):
        table.create(spark.createDataFrame([("r", "k", "1")], LABELS), "record_id", 2)
    assert not [n for n in os.listdir(f"{place.removeprefix('file://')}/versions") if n.startswith(".") and not n.endswith(".crc")]


def test_deletes_and_patches(spark, place):
    table = VersionedTable(spark, place)
    table.create(spark.createDataFrame([("a", "x", "y"), ("b", None, "z")], "id string, caption string, title string"), "id", 3)
    writes.apply_patches(table, spark.createDataFrame([("b", "new", True, None, False), ("c", "", True, "t", True)], "id string, caption string, has_caption boolean, title string, has_title boolean"), ["caption", "title"])
    assert {tuple(r) for r in table.read().collect()} == {("a", "x", "y"), ("b", "new", "z"), ("c", None, "t")}
    assert writes.apply_deletes(table, spark.createDataFrame([("a",), ("a",), ("none",)], "id string")) == 1
    assert writes.apply_deletes(table, spark.createDataFrame([], "id string")) == 0
    assert {r.id for r in table.read().collect()} == {"b", "c"}
    assert writes.apply_deletes(table, table.read().select("id")) == 2 and table.read().count() == 0 and table.version().folders == {}


def test_old_versions_and_folders_are_bounded(spark, tmp_path):
    feed, place = f"{tmp_path}/feed", f"file://{tmp_path}/fresh"
    for n in range(5):
        spark.createDataFrame([(k, n * 10 + k, n) for k in range(n, n + 6)], "id long, event_id long, ts long").coalesce(1).write.mode("append").parquet(feed)
        got = freshness.fresh_snapshot(freshness.change_stream(spark, feed), place, bucket_rows=3)
    want = {}
    for n in range(5):
        want |= {k: n * 10 + k for k in range(n, n + 6)}
    assert {r.id: r.event_id for r in got.collect()} == want
    table = VersionedTable(spark, f"{place}/snapshot")
    assert len(table.numbers()) == 2 and table.version().buckets == buckets_for(6, 3)
    assert len([f for f in os.listdir(f"{tmp_path}/fresh/snapshot/data") if not f.startswith(".")]) <= 4
    # the stream's own note of its last batch is lost: the batch comes again, and is left out
    for n in ("4", ".4.crc"):
        os.remove(f"{tmp_path}/fresh/checkpoint/commits/{n}")
    assert {r.id: r.event_id for r in freshness.fresh_snapshot(freshness.change_stream(spark, feed), place).collect()} == want


FEED = "id long, event_id long, ts string"


def test_a_cursor_is_stored_with_its_rows(spark, place, monkeypatch):
    table = VersionedTable(spark, place)
    rows = [(k % 700, k, f"2024-01-{k // 100 + 1:02d}") for k in range(2000)]
    feed = lambda n: spark.createDataFrame(rows[:n], FEED)
    state = lambda n: {k: max(e for i, e, _ in rows[:n] if i == k) for k in {r[0] for r in rows[:n]}}
    got = lambda: {r.id: r.event_id for r in table.read().collect()}
    assert freshness.synced(table, feed(500), buckets=3) == 500 and got() == state(500)
    assert table.version().marks["cursor"] == "2024-01-05"
    with monkeypatch.context() as m:  # dies between writing and committing

        def never(self, version):
            raise OSError("killed")

        m.setattr(VersionedTable, "commit", never)
        with pytest.raises(OSError):
            freshness.synced(table, feed(1400))
    assert got() == state(500) and table.version().marks["cursor"] == "2024-01-05"
    assert freshness.synced(table, feed(1400)) == 900 and got() == state(1400)  # over 500 changes at once
    number = table.version().number
    assert freshness.synced(table, feed(1400)) == 0 and table.version().number == number  # nothing later: no new version
    assert freshness.synced(table, spark.createDataFrame([(1, 9999, "2023-12-31")], FEED)) == 0  # a cursor never falls
    assert freshness.synced(table, feed(2000)) == 600 and got() == state(2000) and table.version().marks["cursor"] == "2024-01-20"


def test_an_empty_feed_makes_no_table(spark, place):
    table = VersionedTable(spark, place)
    assert freshness.synced(table, spark.createDataFrame([], FEED)) == 0 and table.version() is None
    shutil.rmtree(place.removeprefix("file://"), ignore_errors=True)


def test_a_pass_is_counted_as_it_is_written(spark, tmp_path):
    from tessera.operators import store

    scan = spark.createDataFrame([(f"r{k}",) for k in range(9)], "id string")
    faces = spark.createDataFrame([(f"r{k}", 1 if k < 4 else 0) for k in range(6)], "record_id string, v int")
    assert store.planned_pass(scan, faces, f"{tmp_path}/a") == {"eligible": 9, "skipped": 4, "stale": 2, "new": 3}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/a").collect()} == {("r4", "stale"), ("r5", "stale"), ("r6", "new"), ("r7", "new"), ("r8", "new")}
    done = spark.createDataFrame([(f"r{k}", 1) for k in range(9)], "record_id string, v int")
    assert store.planned_pass(scan, done, f"{tmp_path}/b") == {"eligible": 9, "skipped": 9, "stale": 0, "new": 0}
