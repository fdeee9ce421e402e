"""Keyed state over several micro-batches and restarts, against batch windows and plain loops."""

import random

from pyspark.sql import functions as F

from tessera.streaming import freshness, keyed

FLAGS = "id long, event_id long, ts timestamp_ntz, flag boolean"
CHANGES = "id long, event_id long, ts timestamp_ntz, event_type string, value double"


def feed(spark, rows, kind):
    """Rows of id, event_id, seconds and others, in the order of time."""
    df = spark.createDataFrame(rows, kind.replace("ts timestamp_ntz", "ts long"))
    return df.withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz")).select(*[c.split()[0] for c in kind.split(", ")])


def stream(spark, path, kind):
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)


def test_toggle_edges_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(12), k, k // 2, rng.random() < 0.5) for k in range(400)]
    path, place = f"{tmp_path}/feed", f"file://{tmp_path}/state"
    for part in range(4):  # two batches, then a restart, then two more
        feed(spark, rows[part * 100 : part * 100 + 100], FLAGS).coalesce(1).write.mode("append").parquet(path)
        if part % 2:
            got = {tuple(r) for r in keyed.toggle_edges(stream(spark, path, FLAGS), place, 3).collect()}
            so_far = feed(spark, rows[: part * 100 + 100], FLAGS)
            assert got == {(r.id, r.event_id, r.action) for r in freshness.toggles(so_far, "id", "flag").collect()}
    late = [(0, 5000, 1, True), (0, 5001, 1, False), (99, 5002, 1, True)]
    feed(spark, late, FLAGS).coalesce(1).write.mode("append").parquet(path)
    assert {tuple(r) for r in keyed.toggle_edges(stream(spark, path, FLAGS), place, 3).collect()} == got | {(99, 5002, "publish")}


def test_changes_replace_in_place_and_new_ids_are_appended(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(30), k, k, f"t{k % 3}", float(k)) for k in range(150)]
    path, place = f"{tmp_path}/feed", f"file://{tmp_path}/state"
    shown = []
    for part in range(3):
        some = rows[part * 50 : part * 50 + 50]
        feed(spark, some, CHANGES).coalesce(1).write.mode("append").parquet(path)
        for r in some:  # the list as it is shown
            at = next((k for k, x in enumerate(shown) if x[0] == r[0]), None)
            if at is None:
                shown.append(r)
            else:
                shown[at] = r
        if part != 1:
            got = keyed.arrival_snapshot(stream(spark, path, CHANGES), place, 3).orderBy("arrived_micros", "arrived_event").collect()
            assert [(r.id, r.event_id, r.event_type, r.value) for r in got] == [(r[0], r[1], r[3], r[4]) for r in shown]


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with keyed.settings(spark, {"spark.sql.shuffle.partitions": "3", "spark.tessera.none": "x"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("spark.tessera.none", None) is None


def test_a_feed_in_several_files_gives_the_same_snapshot(spark, monkeypatch):
    """No task writes a whole part of the feed; an id's changes of a part stay together."""
    from tessera.plans import applied

    sf, written = "/root/testdata/sf0.001", []
    monkeypatch.setattr(applied, "FED_ROWS", 100, raising=False)
    folder = freshness.folder
    monkeypatch.setattr(freshness, "folder", lambda spark, what: (written.append(folder(spark, what)), written[-1])[1])
    got = {tuple(r) for r in applied.arrival_snapshot(spark, sf).collect()}
    assert len(spark.read.parquet(next(w for w in written if "/arrivals-" in w)).inputFiles()) > 6
    by = {}
    for r in applied.src.changes(spark, sf).collect():
        by.setdefault(r.id, []).append((r.ts, r.event_id, r.event_type))
    assert got == {(i, max(rows)[1], max(rows)[2], min(rows)[1]) for i, rows in by.items()}
