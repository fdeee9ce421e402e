"""Removal of repeats where ids don't tell the order: null ids, one id on different texts, rows in many copies."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_dedup
from tessera.llm.suffix_dedup import LAST_ID, Rolling, cut_docs, cut_repeats, suffix_digest

DOCS = "doc_id long, text string"


def in_order(df):
    """Distinct (id, text) in the order that the operator states."""
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = df.distinct().select("doc_id", "text", F.xxhash64(F.coalesce("doc_id", F.lit(LAST_ID)), tag).alias("place")).collect()
    return [(r.doc_id, r.text) for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.place % (1 << 64)))]


def plain(order):
    seen, out = {}, {}
    for n, (key, text) in enumerate(order):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if seen.setdefault(raw[i : i + 100], (n, i)) != (n, i):
                gone[i : i + 100] = True
        out[key, text] = bytes(np.frombuffer(raw, np.uint8)[~gone])
    return out


def passages(rng, n):
    return " ".join(str(rng.randrange(10**18)) for _ in range(n))


def tied_rows():
    rng = random.Random(9)
    rows = []
    for k in range(40):  # pairs that share a passage, under one id, none, or two
        shared = passages(rng, 20)
        ids = ((k, k), (None, None), (1000 + 2 * k, 1001 + 2 * k), (5, None))[k % 4]
        rows += [(i, passages(rng, rng.randint(1, 9)) + shared + passages(rng, rng.randint(0, 9))) for i in ids]
    shared = passages(rng, 12)
    rows += [(7, f"{passages(rng, 3)} {shared} {shared}") for _ in range(5)] + [(None, shared + passages(rng, 2)) for _ in range(5)]
    return rows + [rows[3]] * 5 + [rows[-1]] * 4 + [(None, None), (None, ""), (3, None), (3, "")]


@pytest.mark.parametrize("block_bytes", [1 << 10, 8 << 20])
@pytest.mark.parametrize("frequent", [3, 1 << 15])
def test_tied_ids_equal_brute_force(spark, block_bytes, frequent):
    rows = tied_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    want = plain(in_order(df))
    got = cut_docs(df, frequent, block_bytes).select("row.doc_id", "row.text", "kept").collect()
    assert Counter((r.doc_id, r.text, bytes(r.kept)) for r in got) == Counter((*k, want[k]) for k in rows)


def test_a_shared_passage_stays_once(spark):
    rng = random.Random(2)
    pairs = [(passages(rng, 20), [passages(rng, 5), passages(rng, 5)]) for _ in range(30)]
    for ids in ((0, 0), (None, None)):
        df = spark.createDataFrame([(None if i is None else n, own + shared) for n, (shared, owns) in enumerate(pairs) for i, own in zip(ids, owns)], DOCS)
        left = [r.text for r in cut_repeats(df).collect()]
        assert [sum(shared[-300:] in t for t in left) for shared, _ in pairs] == [1] * len(pairs)


def test_a_row_in_very_many_copies(spark):
    """Copies don't come into a block: it would hold 60 MB of them."""
    text = "a line of some length, " * 20
    many = spark.range(120_000).select(F.when(F.col("id") % 2 == 0, F.lit(4)).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.col("id").alias("extra"))
    more = spark.createDataFrame([(1, "x" + text[:300], -1), (9, text, -2)], "doc_id long, text string, extra long")
    got = cut_docs(many.unionByName(more)).select("row.doc_id", "row.extra", F.octet_length("kept").alias("n"))
    assert got.select("extra").distinct().count() == 120_002
    found = {(r.doc_id, r.n): r["count"] for r in got.groupBy("doc_id", "n").count().collect()}
    first = plain([(1, "x" + text[:300]), (4, text), (9, text), (None, text)])
    want = Counter({(4, len(first[4, text])): 60_000, (None, len(first[None, text])): 60_000, (9, len(first[9, text])): 1, (1, len(first[1, "x" + text[:300]])): 1})
    assert found == dict(want)


def test_ids_have_to_be_integers(spark):
    for kind in ("string", "double"):
        with pytest.raises(ValueError, match="integer"):
            suffix_digest(spark.createDataFrame([(1, "t")], DOCS).withColumn("doc_id", F.col("doc_id").cast(kind)))


def test_equal_names_of_one_hash_alone_remove_nothing(spark, monkeypatch):
    """Where the first 64 bits are equal by chance, the further bits tell strings apart."""
    data = np.frombuffer(passages(random.Random(1), 60).encode(), np.uint8)
    roll = Rolling(data)
    at = np.arange(500)
    assert len(set(roll.more(at, at + 44).tolist())) == 500 and len(set(roll(at, at + 44).tolist())) == 500
    block = suffix_dedup.Entries(np.zeros(3, np.uint64), np.array([1, 2, 1], np.uint32), np.arange(3), np.zeros(3, np.int64), np.full(3, 100))
    assert block.again(b"\0\0").tolist() == [False, False, True]
    streams = [(n, 0, suffix_dedup.pack(suffix_dedup.steps(np.array([5, 5], np.uint64)), np.array([n, 9], np.uint32), np.array([1, 1]), np.zeros(2, np.uint32), np.zeros(2, np.uint32))) for n in (0, 1)]
    import zlib

    assert [list(zlib.decompress(r[4])) for r in suffix_dedup.first_entries(streams)] == [[0, 0], [0, 1]]
