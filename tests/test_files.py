"""Files one for each record, files held against digests, and EXIF from bytes."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions import exif
from tessera.functions.exif import walked
from tessera.sources import downloads, sidecars
from tessera.sources.file_store import STAGING, Reader, Writer, file_name, local, read_files, write_files

ROWS = "record_id string, body string"
ODD = ["plain", "a/b", "..", ".hidden", "ü %20", "x" * 90, "q?&#"]


def test_written_files_are_read_back(spark, tmp_path):
    place = f"file://{tmp_path}/store"
    os.makedirs(f"{tmp_path}/store")
    rows = [(i, f"body of {i}\r\nß") for i in ODD] + [(f"r{k}", str(k)) for k in range(150)]
    write_files(spark.createDataFrame(rows, ROWS).repartition(5), place)
    got = read_files(spark, place, files=40)
    assert got.rdd.getNumPartitions() == 4 and {tuple(r) for r in got.collect()} == set(rows)
    assert {r.record_id for r in sidecars.bodies(spark, place).collect()} == {file_name(i, "") for i, _ in rows}
    write_files(spark.createDataFrame([("plain", "new"), ("more", None)], ROWS), place)
    kept = dict(map(tuple, read_files(spark, place).collect()))
    assert kept["plain"] == "new" and kept["more"] == "" and len(kept) == len(rows) + 1
    write_files(spark.createDataFrame([("only", "1")], ROWS), place, "overwrite")
    assert [tuple(r) for r in read_files(spark, place).collect()] == [("only", "1")]
    assert not [n for n in os.listdir(f"{tmp_path}/store") if n.startswith(STAGING)]


def test_a_failed_job_leaves_what_stood(spark, tmp_path):
    place = f"{tmp_path}/store"
    write_files(spark.createDataFrame([("a", "old")], ROWS), place)
    fail = F.udf(lambda k: "new" if k < 30 else 1 / 0, "string")
    with pytest.raises(Exception):
        write_files(spark.range(0, 40, 1, 4).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("record_id"), fail("id").alias("body")), place)
    assert [tuple(r) for r in read_files(spark, place).collect()] == [("a", "old")]
    assert os.listdir(place) == ["a.json"]


def test_an_attempt_that_is_left_behind_counts_for_nothing(tmp_path):
    from pyspark.sql import Row

    os.makedirs(f"{tmp_path}/s")
    writer = Writer(f"{tmp_path}/s", ".json", False)
    writer.write(iter([Row(record_id="a", body="lost try")]))  # its task dies after writing
    again = writer.write(iter([Row(record_id="a", body="second try")]))
    writer.commit([again, None])
    assert os.listdir(f"{tmp_path}/s") == ["a.json"] and Reader(f"{tmp_path}/s", ".json", 9).body("a.json") == "second try"


def test_unreadable_and_missing_files(spark, tmp_path):
    assert read_files(spark, f"{tmp_path}/none").count() == 0
    os.makedirs(f"{tmp_path}/s")
    (tmp_path / "s" / "bad.json").write_bytes(b"\xff\xfe{")
    (tmp_path / "s" / "good.json").write_text('{"v":1,"faces":[]}')
    (tmp_path / "s" / "note.txt").write_text("x")
    read = read_files(spark, f"{tmp_path}/s")
    assert {tuple(r) for r in read.collect()} == {("bad", None), ("good", '{"v":1,"faces":[]}')}
    assert [r.record_id for r in sidecars.parsed(read).collect()] == ["good"]
    with pytest.raises(ValueError, match="mounted"):
        local("s3a://bucket/x")
    assert file_name("..", ".json") == "%2E..json"
    with pytest.raises(ValueError, match="without an id"):
        file_name("", ".json")


def test_files_are_held_against_digests(spark, tmp_path):
    import hashlib

    os.makedirs(f"{tmp_path}/models/deep")
    bodies = {"good": b"abc", "cut": b"ab", "changed": b"abd", "extra": b"?", "large": b"x" * 50, "deep/inner": b"in"}
    for name, body in bodies.items():
        (tmp_path / "models" / name).write_bytes(body)
    want = [("good", b"abc"), ("cut", b"abc"), ("changed", b"abc"), ("gone", b"abc"), ("large", b"x" * 50), ("inner", b"in")]
    expected = spark.createDataFrame([(n, len(b), hashlib.sha256(b).hexdigest()) for n, b in want], "name string, size long, sha256 string")
    got = downloads.checked(spark, f"{tmp_path}/models", expected, most=40)
    assert {r.name: r.status for r in got.collect()} == {"good": "ok", "cut": "size", "changed": "digest", "gone": "missing", "extra": "unexpected", "large": "too large", "inner": "ok"}
    downloads.quarantined(got.where("status in ('size', 'digest', 'missing')"), f"{tmp_path}/models", f"{tmp_path}/aside")
    assert sorted(os.listdir(f"{tmp_path}/aside")) == ["changed", "cut"] and sorted(os.listdir(f"{tmp_path}/models")) == ["deep", "extra", "good", "large"]


def tiff(order, main, camera=(), place=(), pointers=True):
    """A TIFF structure of entries (tag, type, count, value bytes)."""
    sizes = [2 + 12 * (len(main) + 2 * pointers) + 4, 2 + 12 * len(camera) + 4, 2 + 12 * len(place) + 4]
    starts = [8, 8 + sizes[0], 8 + sizes[0] + sizes[1]]
    data, at = b"", 8 + sum(sizes)
    main = list(main) + [(0x8769, 4, 1, struct.pack(order + "I", starts[1])), (0x8825, 4, 1, struct.pack(order + "I", starts[2]))] * pointers
    out = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    for entries in (main, camera, place):
        out += struct.pack(order + "H", len(entries))
        for tag, kind, count, value in entries:
            out += struct.pack(order + "HHI", tag, kind, count)
            if len(value) <= 4:
                out += value.ljust(4, b"\0")
            else:
                out += struct.pack(order + "I", at + len(data))
                data += value
        out += b"\0" * 4
    return out + data


def whole(order):
    r = lambda *x: struct.pack(order + "I" * len(x), *x)
    main = [(0x010F, 2, 3, b"Me\0"), (0x0110, 2, 9, b"Model 12\0"), (0x0112, 3, 1, struct.pack(order + "H", 6))]
    camera = [(0x829A, 5, 1, r(1, 60)), (0x829D, 5, 1, r(28, 10)), (0x8827, 3, 1, struct.pack(order + "H", 200)), (0x9004, 2, 20, b"2020:02:03 04:05:06\0"), (0xA434, 2, 6, b"Wide \0")]
    place = [(1, 2, 2, b"S\0"), (2, 5, 3, r(10, 1, 30, 1, 36, 1)), (3, 2, 2, b"E\0"), (4, 5, 3, r(20, 1, 0, 1, 0, 1))]
    return main, camera, place


@pytest.mark.parametrize("order", "<>")
def test_fields_in_both_orders(order):
    got = walked(tiff(order, *whole(order)))
    assert (got["make"], got["model"], got["orientation"], got["f_number"], got["iso"], got["lens"]) == ("Me", "Model 12", 6.0, 2.8, 200.0, "Wide ")
    assert got["lat"] == pytest.approx(-10.51) and got["lon"] == 20.0 and got["digitized"] == "2020:02:03 04:05:06" and got.get("original") is None
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xe1\x00\x08Other\0\xff\xe1" + struct.pack(">H", len(tiff(order, *whole(order))) + 8) + b"Exif\0\0" + tiff(order, *whole(order)) + b"\xff\xd9"
    assert walked(jpeg) == got


@pytest.mark.parametrize("order", "<>")
def test_any_failure_leaves_nothing(order):
    data = tiff(order, *whole(order))
    none = walked(None)
    assert not any(none.values()) and walked(b"") == walked(b"GIF89a") == walked(b"\xff\xd8\xff\xd9") == none
    for n in range(1, len(data)):
        assert not any(walked(data[:n]).values()), n  # cut anywhere: no field at all
    loop = tiff(order, [(0x010F, 2, 3, b"Me\0"), (0x8769, 4, 1, struct.pack(order + "I", 8))], pointers=False)
    far = tiff(order, [(0x010F, 2, 3, b"Me\0"), (0x8825, 4, 1, struct.pack(order + "I", 1 << 30))], pointers=False)
    many = tiff(order, [(0x010F, 2, 1 << 31, b"Me\0")], pointers=False)
    assert walked(loop) == walked(far) == walked(many) == none
    assert not any(walked(b"\xff\xd8\xff\xe1\xff\xffExif\0\0" + data).values())


def test_random_bytes_never_raise():
    rng = random.Random(1)
    data = tiff("<", *whole("<"))
    for _ in range(3000):
        b = bytearray(data)
        for _ in range(rng.randint(1, 6)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        walked(bytes(b))


def test_odd_values_are_null():
    r = struct.pack("<II", 1, 0)
    got = walked(tiff("<", [(0x010F, 2, 1, b"\0"), (0x0110, 3, 1, b"\1\0"), (0x0112, 2, 2, b"x\0")], [(0x829D, 5, 1, r), (0x829A, 99, 1, b"")], [(2, 5, 2, r + r)]))
    assert not any(got.values())


def test_columns_of_bytes(spark):
    rows = [(1, tiff("<", *whole("<"))), (2, tiff(">", [(0x0110, 2, 9, b"Model 12\0")], [(0x9003, 2, 20, b"2021:01:01 00:00:00\0"), (0x9004, 2, 20, b"2020:02:03 04:05:06\0"), (0x829A, 5, 1, struct.pack(">II", 2, 1))])), (3, None), (4, b"x")]
    got = spark.createDataFrame(rows, "k int, content binary").select("k", exif.exif_fields(F.col("content")).alias("r"))
    rows = {r.k: r for r in got.select("k", *[c.alias(n) for n, c in exif.exif_columns(F.col("r")).items()]).collect()}
    assert (rows[1].captured_at, rows[1].exposure_time, rows[2].captured_at, rows[2].exposure_time) == ("2020-02-03T04:05:06", "1/60s", "2021-01-01T00:00:00", "2s")
    assert all(v is None for k in (3, 4) for n, v in rows[k].asDict().items() if n != "k")


def test_names_pass_neither_through_partitions_nor_messages(tmp_path):
    """What a task is given or gives back doesn't grow with its files, and there are a bounded number of tasks."""
    import pickle

    from pyspark.sql import Row

    from tessera.sources.file_store import SHARES

    place = f"{tmp_path}/s"
    os.makedirs(place)
    names = {f"r{k}" for k in range(SHARES * 3)}
    writer = Writer(place, ".json", False)
    messages = [writer.write(iter([Row(record_id=n, body=n) for n in some])) for some in (["r0"], sorted(names))]
    assert len(pickle.dumps(messages[1])) == len(pickle.dumps(messages[0]))
    writer.commit(messages)
    reader = Reader(place, ".json", 1)
    parts = reader.partitions()
    assert len(parts) == SHARES and max(len(pickle.dumps(p)) for p in parts) < 200
    got = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert len(got) == len(names) and {r["record_id"] for r in got} == names == {r["body"] for r in got}


def test_files_are_listed_in_tasks(spark, tmp_path):
    os.makedirs(f"{tmp_path}/f/in/_not")
    for name in ("a", "in/b", ".c", "_d", "in/_not/e", "k=1"):
        (tmp_path / "f" / name).write_text(name)
    got = downloads.listed(spark, f"file://{tmp_path}/f")
    assert {(r.name, bytes(r.path), r.length) for r in got.collect()} == {(n.split("/")[-1], f"{tmp_path}/f/{n}".encode(), len(n)) for n in ("a", "in/b", "k=1")}
    assert got.rdd.getNumPartitions() > 1
    with pytest.raises(FileNotFoundError):
        downloads.listed(spark, f"{tmp_path}/none")
