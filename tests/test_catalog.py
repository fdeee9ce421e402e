"""Small hand-built cases of the media-catalog operators: golden values, brute force, odd inputs."""

import base64
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import catalog, clustering, detection, gallery, publish, store, upsert, vectors
from tessera.operators.ranges import ranged, ranked
from tessera.sources import sidecars
from tessera.streaming import freshness

FACES = "record_id string, face_index int, vec_id long, embedding array<float>, img int"


def angle(a):
    return [math.cos(a), math.sin(a), 0.0, 0.0]


def angled(spark, angles, img=0):
    return spark.createDataFrame([(f"r{k}", 0, k, angle(a), img) for k, a in enumerate(angles)], FACES)


def brute_clusters(rows, threshold):
    """(record, face, id, vector) in order: the cluster of each, by the newest centroid of largest score."""
    held, out = [], {}
    for _, _, key, v in sorted(rows):
        v = np.asarray(v, np.float32)
        best, score = None, threshold
        for k, (c, _) in enumerate(held):
            if len(c) == len(v) and (s := float(c.astype(float) @ v.astype(float))) >= score:
                best, score = k, s
        if best is None:
            held.append((v, 1))
            out[key] = (len(held) - 1, 1)
        else:
            c, n = held[best]
            mean = ((c.astype(float) * n + v) / (n + 1)).astype(np.float32)
            held[best] = ((mean.astype(float) / float(np.sqrt((mean.astype(float) ** 2).sum()))).astype(np.float32), n + 1)
            out[key] = (best, n + 1)
    return out


@pytest.mark.parametrize(("angles", "threshold", "sizes"), [((0, 0.1, math.pi / 2), 0.45, [1, 2]), ((0, 0.6), 0.45, [2]), ((0, 0.6), 0.9, [1, 1])])
def test_clusters_of_angles(spark, angles, threshold, sizes):
    got = clustering.online_clusters(angled(spark, angles), "img", threshold).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got) == sizes


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        wide = 5 if k % 50 == 7 else 4  # another length now and then
        v = rng.normal(size=wide)
        rows.append((f"r{k % 97:03}", k // 97, k, (v / np.linalg.norm(v)).tolist()))
    rows += [("r001", 9, 1000, rows[5][3]), ("r001", 10, 1001, rows[5][3])]
    faces = spark.createDataFrame([(*r, 0) for r in rows] + [("r0", 0, None, [1.0], 0), ("r0", 0, 5000, None, 0)], FACES)
    got = {r.vec_id: (r.cluster, r["size"]) for r in clustering.online_clusters(faces.repartition(5), "img", 0.6).collect()}
    assert got == brute_clusters(rows, 0.6)


def test_clusters_go_on_from_a_roster(spark):
    faces = angled(spark, (0.05, 2.0)).withColumn("person_id", F.lit(None).cast("string")).unionByName(angled(spark, (0.0,)).withColumn("person_id", F.lit("a")))
    roster = spark.createDataFrame([(0, "a", 1, angle(0.0)), (0, "b", 3, angle(2.0))], "img int, person_id string, face_count long, centroid array<float>")
    got = {r.vec_id: (r.cluster, r["size"]) for r in clustering.online_clusters(faces, "img", 0.45, roster).collect()}
    assert got == {0: (0, 2), 1: (1, 4)}
    again = faces.withColumn("person_id", F.coalesce("person_id", F.lit("a")))
    assert clustering.online_clusters(again, "img", 0.45, roster).count() == 0
    assert clustering.reclustered(again, "img", 0.45).count() == 3


def test_merge_with_an_unknown_target(spark):
    people = spark.createDataFrame([("a", "", 2, angle(0)), ("b", "Ann", 1, angle(1))], "person_id string, name string, face_count long, centroid array<double>")
    faces = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "vec_id long, person_id string")
    same, kept = clustering.merged_with_faces(people, faces, "none", ["a"])
    assert sorted(r.person_id for r in same.collect()) == ["a", "b"] and kept.collect() == faces.collect()
    one, moved = clustering.merged_with_faces(people, faces, "a", ["b", "gone"])
    assert [(r.person_id, r.name, r.face_count) for r in one.collect()] == [("a", "Ann", 3)]
    assert {r.vec_id: r.person_id for r in moved.collect()} == {1: "a", 2: "a", 3: None}


def brute_batches(plan, budget):
    batch, fill, out = 0, 0, {}
    for record, key, values in sorted(plan):
        cost = max(1, len(values))
        if fill > 0 and fill + cost > budget:
            batch, fill = batch + 1, 0
        out[record, key] = batch
        fill += cost
    return out


@pytest.mark.parametrize("budget", [7, 50, 2000])
def test_batches_equal_brute_force(spark, budget):
    rng = random.Random(budget)
    plan = [(f"record-id-{k:06}", key, ["v"] * rng.choice((0, 1, 1, 2, 9, 60))) for k in range(1500) for key in ("faceCount", "faces")]
    df = spark.createDataFrame(plan, "record_id string, key string, values array<string>").repartition(6)
    got = {(r.record_id, r.key): r.batch for r in publish.batched(df, budget, ranges=13).collect()}
    assert got == brute_batches(plan, budget)


def test_ranges_of_ids_with_one_prefix(spark):
    ids = spark.createDataFrame([(f"record-id-{k:06}",) for k in range(3000)], "id string").repartition(7)
    sizes = [r["count"] for r in ranged(ids, "id", 10).groupBy("range").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 900
    assert {r.id: r["rank"] for r in ranked(ids, "id", 10).collect()} == {f"record-id-{k:06}": k for k in range(3000)}
    records = ids.withColumn("content_hash", F.lit("x"))
    got = {r.id: r.batch for r in catalog.lookup_batches(ids.union(ids), records, 100, ranges=10).collect()}
    assert got == {f"record-id-{k:06}": k // 100 for k in range(3000)}
    assert ranked(ids.limit(0), "id").count() == 0


def test_matches_by_the_salted_join(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = {(q, k) for q in range(0, 300, 10) for k in range(300) if k != q and x[q] @ x[k] >= 5}
    for limit in (64 << 20, 0):
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", limit)
        assert {(r.query_id, r.vec_id) for r in vectors.matches_over(df, F.col("vec_id") % 10 == 0, 5.0).collect()} == want


def test_orphans_of_an_empty_scan_set(spark):
    faces = spark.createDataFrame([("a",), ("b",)], "record_id string")
    known = spark.createDataFrame([("a",)], "id string")
    assert [r.record_id for r in store.orphans(known, faces).collect()] == ["b"]
    assert store.orphans(known.limit(0), faces).count() == 0


def test_sidecar_folder(spark, tmp_path):
    one = '{"v":1,"model":"%s","w":10,"h":5,"faces":[{"bbox":[0,0,1,1],"score":0.5,"kps":[[1,2]],"embedding":"AAAA","personId":null}]}' % store.MODEL
    for name, body in (("a b", one), ("empty", '{"v":1,"model":"%s","faces":[]}' % store.MODEL), ("broken", "{"), ("odd", '{"v":1,"faces":{"a":1}}')):
        (tmp_path / f"{name}.json").write_text(body)
    (tmp_path / "c.tmp").write_text(one)
    got = {r.record_id: len(r.faces) for r in sidecars.sidecars(spark, str(tmp_path)).collect()}
    assert got == {"a b": 1, "empty": 0}
    status = store.files_status(sidecars.sidecars(spark, str(tmp_path))).first()
    assert (status.on_disk, status.processed, status.images_with_faces, status.faces) == (2, 2, 1, 1)
    scan = spark.createDataFrame([("a b",), ("empty",), ("broken",)], "id string")
    assert [r.id for r in store.pending_files(scan, sidecars.sidecars(spark, str(tmp_path))).collect()] == ["broken"]
    assert sidecars.sidecars(spark, str(tmp_path / "none")).count() == 0
    assert sidecars.people(spark, str(tmp_path / "people.json")).count() == 0
    (tmp_path / "people.json").write_text('[{"id":"1","name":"Ann","faceCount":2}]')
    assert [(r.id, r.name, r.faceCount) for r in sidecars.people(spark, str(tmp_path / "people.json")).collect()] == [("1", "Ann", 2)]
    (tmp_path / "people.json").write_text("oops")
    assert sidecars.people(spark, str(tmp_path / "people.json")).count() == 0


def test_detector_errors(spark):
    anchors = detection.anchor_grid(spark)
    raw = spark.createDataFrame([(1, 32, 800, 0.9, 1.0, 1.0, 1.0, 1.0, [0.0] * 10)], "img int, stride int, anchor long, score double, l double, t double, r double, b double, kps array<double>")
    with pytest.raises(PySparkException):
        detection.decode_boxes(raw, anchors).collect()
    assert detection.decode_boxes(raw, anchors, 0.95).count() == 0
    heads = [(1, k, [2 * (640 // s) ** 2, w]) for k, (s, w) in enumerate((s, w) for s in (8, 16, 32) for w in (1, 4, 10))]
    schema = "img int, tensor_id long, dims array<int>"
    assert detection.grouped_heads(spark.createDataFrame(heads, schema)).count() == 3
    for bad in (heads[:-1], [*heads, (1, 99, [7, 1])], [*heads, (1, 99, [800, 5])]):
        with pytest.raises(PySparkException):
            detection.grouped_heads(spark.createDataFrame(bad, schema)).collect()


def test_golden_boxes(spark):
    def keep(boxes, scores, threshold):
        df = spark.createDataFrame([(0, k, s, *map(float, b)) for k, (b, s) in enumerate(zip(boxes, scores))], "img int, vec_id long, score double, x1 double, y1 double, x2 double, y2 double")
        return [r.vec_id for r in detection.suppressed_boxes(df, threshold).orderBy("place").collect()]

    assert keep([(0, 0, 10, 10), (1, 1, 11, 11)], [0.6, 0.9], 0.4) == [1]
    assert keep([(0, 0, 1, 1), (5, 5, 6, 6), (9, 9, 10, 10)], [0.3, 0.9, 0.6], 0.4) == [1, 2, 0]


def test_warp_and_fit(spark):
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (9, 7, 3), np.uint8)
    t = {"a": 8.0, "b": 0.0, "c": 0.0, "d": 8.0, "tx": 3.0, "ty": -2.0}
    kind = "struct<a:double,b:double,c:double,d:double,tx:double,ty:double>"
    df = spark.createDataFrame([(1, 7, 9, pixels.tobytes(), t), (2, 7, 9, pixels.tobytes(), dict.fromkeys(t, 0.0))], f"id int, width int, height int, rgb binary, t {kind}")
    got = {r.id: r.crop for r in detection.warped(df, 16).collect()}
    assert got[2] is None
    crop = np.frombuffer(got[1], np.uint8).reshape(16, 16, 3)
    for y, x in ((0, 0), (5, 9), (15, 15)):
        sx, sy = (x + 0.5 - 3) / 8 - 0.5, (y + 0.5 + 2) / 8 - 0.5
        x0, y0 = math.floor(sx), math.floor(sy)
        at = lambda b, a: pixels[min(max(b, 0), 8), min(max(a, 0), 6)].astype(float)
        want = (at(y0, x0) * (1 - sx + x0) + at(y0, x0 + 1) * (sx - x0)) * (1 - sy + y0) + (at(y0 + 1, x0) * (1 - sx + x0) + at(y0 + 1, x0 + 1) * (sx - x0)) * (sy - y0)
        assert crop[y, x].tolist() == [math.floor(v + 0.5) for v in want]


def test_wire_vectors(spark):
    v = [0.5, -0.25, 1e-7, 0.125]
    df = spark.createDataFrame([(1, v), (2, None)], "vec_id long, embedding array<float>")
    wires = {r.vec_id: r.wire for r in vectors.encode_base64(df).collect()}
    assert wires == {1: base64.b64encode(np.array(v, "<f4").tobytes()).decode(), 2: None}
    odd = spark.createDataFrame([(1, wires[1]), (2, "AAAA"), (3, "?"), (4, None)], "vec_id long, wire string")
    back = {r.vec_id: r.embedding for r in vectors.decode_base64(odd).collect()}
    assert np.array_equal(np.float32(back[1]), np.float32(v)) and back[2] is back[3] is back[4] is None


def test_texts(spark):
    pad = "   ﻿"
    row = spark.range(1).select(
        scalars.trimmed(F.lit(f"{pad}a b{pad}")).alias("trimmed"),
        scalars.utf16_units(F.lit("a😀")).alias("units"),
        scalars.date_text(F.lit("2024-01-02T03:04:05.678Z")).alias("date"),
        scalars.camera_text(F.lit(None), F.lit("M")).alias("none"),
        scalars.aperture_text(F.lit(2.8)).alias("f"),
        scalars.range_floor(F.lit("~1.2.3-rc")).alias("floor"),
        scalars.exif_date(F.lit("2024:01:02 03:04:05\n")).alias("exif"),
        scalars.upload_type(F.lit("a.BMP"), F.lit("")).alias("type"),
    ).first()
    assert row.asDict() == {"trimmed": "a b", "units": 3, "date": "2024-01-02 03:04:05", "none": None, "f": "f/2.8", "floor": "1.2.3", "exif": None, "type": "application/octet-stream"}


def test_long_captions_are_refused(spark):
    old = spark.createDataFrame([("a", "old")], "record_id string, caption string")
    patches = spark.createDataFrame([("a", "😀" * 1001, True), ("b", "😀" * 1000, True)], "record_id string, caption string, has_caption boolean")
    got = {r.record_id: r.caption for r in upsert.patched(old, patches, "record_id", ["caption"]).collect()}
    assert got == {"a": "old", "b": "😀" * 1000}


def test_tiles(spark):
    rows = [("a", None, "1"), ("b", None, "1"), ("a1", "a", "1"), ("a2", "a", "2"), ("a3", "a", "2"), ("x", "gone", "1")]
    images = spark.createDataFrame([(i, p, c, c) for i, p, c in rows], "id string, parent_id string, created_at string, effective_date string")
    assert [r.id for r in gallery.display_list(images).collect()] == ["a2", "b", "x"]


def test_snapshot_over_two_runs(spark, tmp_path):
    feed, place = str(tmp_path / "feed.parquet"), f"file://{tmp_path}/snap"
    kind = "id long, event_id long, ts timestamp, event_type string"

    def run(rows):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(feed)
        return {r.id: r.event_id for r in freshness.fresh_snapshot(freshness.change_stream(spark, feed), place, bucket_rows=5).collect()}

    from datetime import datetime

    at = lambda n: datetime(2024, 1, 1, 0, n)
    assert run([(k, k, at(1), "a") for k in range(20)]) == {k: k for k in range(20)}
    assert run([(3, 100, at(2), "b"), (4, 101, at(0), "b")]) == {k: 100 if k == 3 else k for k in range(20)}
    assert {r.id for r in freshness.fresh_snapshot(freshness.change_stream(spark, feed), place, bucket_rows=5).collect()} == set(range(20))


def test_a_scope_is_bounded(spark):
    rows = [(k, "r", k, 0, [1.0, 0.0]) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, record_id string, face_index int, scope int, embedding array<float>")
    assert clustering.online_clusters(df, "scope", 0.5, most=5).count() == 5
    with pytest.raises(PySparkException, match="library_clusters"):
        clustering.online_clusters(df, "scope", 0.5, most=4).collect()


def test_an_unknown_target_moves_no_face(spark):
    people = spark.createDataFrame([("1", "a", 1, [1.0, 0.0]), ("2", "b", 1, [0.0, 1.0])], "person_id string, name string, face_count long, centroid array<double>")
    faces = spark.createDataFrame([(1, "1"), (2, "2"), (3, None)], "vec_id long, person_id string")
    for target, want in (("1", {(1, "1"), (2, "1"), (3, None)}), ("none", {(1, "1"), (2, "2"), (3, None)})):
        _, after = clustering.merged_with_faces(people, faces, target, ["2"])
        assert {tuple(r) for r in after.select("vec_id", "person_id").collect()} == want
