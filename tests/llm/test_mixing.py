"""The mix of sources against a plain loop over all rows, sorted source by source."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tessera.llm import mixing, queries
from tessera.llm.mixing import mix_digest, mix_sources, mixed
from tessera.llm.tables import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def spark_hash(seed, doc_id, text):
    """Spark's xxhash64 over an int, a long and a string; nulls leave it as it is."""
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    h = h if doc_id is None else xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), h)
    return h if text is None else xxhash.xxh64_intdigest(text.encode(), h)


def weight_of(text):
    if text is None:
        return 0.1
    shown = re.sub(r"[ \t\n\x0b\f\r]+", "", text)
    lines = text.split("\n")
    return 0.1 + 0.9 * (len(regex.sub(r"\P{L}+", "", shown)) / max(1, len(shown))) * len(set(lines)) / len(lines)


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[k % len(weights)]) for k, s in enumerate(order)}
    total, target, open_ = Fraction(sum(sizes.values())), {}, set(order)
    while True:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= most * sizes[s]}
        if not full:
            return target | share
        target |= {s: Fraction(most * sizes[s]) for s in full}
        open_ -= full
        if not open_:
            return target


def plain_mix(rows, seed=23):
    """Sorted (doc_id, size, source_size, target, taken)."""
    by = defaultdict(list)
    for doc_id, text, source in rows:
        by[source].append((doc_id, text))
    sizes = {s: sum(size_of(t) for _, t in own) for s, own in by.items()}
    target, out = plain_targets(sizes), []
    for s, own in by.items():
        goal = float(target[s])
        epochs = math.floor(goal / sizes[s]) if sizes[s] else 0
        rest, at = goal - epochs * sizes[s], 0
        keyed = []
        for doc_id, text in own:
            u = ((spark_hash(seed + 1, doc_id, text) >> 12) + 0.5) / 2**52
            tie = spark_hash(seed, doc_id, text)
            keyed.append((-math.log(u) / weight_of(text), tie - (tie >> 63 << 64), doc_id, text))
        for _, _, doc_id, text in sorted(keyed, key=lambda x: x[:2]):
            n = size_of(text)
            more = rest > 0 and n > 0 and at + n / 2 <= rest
            out.append((doc_id, n, sizes[s], goal, n * (epochs + more)))
            at += n
    return out


def agrees(got, want):
    rounded = lambda rows: Counter((r[0], r[1], r[2], round(r[3], 3), r[4]) for r in rows)
    assert rounded(got) == rounded(want)


def odd_rows():
    rng = random.Random(3)
    words = ["ab", "Cdé", "12", "x;y", "\n", "zz", "word"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(("b", "a", "hot", "hot", "hot", "", None, "é", "Z"))) for k in range(300)]
    rows += [(None, None, "a"), (1, "", None), (2, " \n ", "blank"), (None, "equal row " * 5, "copies")] + [(None, "equal row " * 5, "copies")] * 40
    rows += [(7, "same id", "hot")] * 3 + [(9000, "long " * 20_000, "long")]
    return rows


@pytest.mark.parametrize("size", [5, 1 << 16])
def test_mix_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(mixing, "BUCKET", size)
    rows = odd_rows()
    got = mix_digest(spark.createDataFrame(rows, DOCS).repartition(7)).collect()
    agrees(got, plain_mix(rows))
    assert all(r.taken <= 3 * r.size for r in got)


def test_whole_documents_equal_brute_force(spark):
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, SF, "documents").collect()]
    agrees(queries.op11_mixing(spark, SF).collect(), plain_mix(rows))


def test_targets_stop_and_are_shared_again(spark):
    rows = [(k, "w " * n, s) for k, (n, s) in enumerate([(1000, "a"), (3, "b"), (5, "c"), (400, "d"), (0, "e"), (40, None)])]
    got = {r.doc_id: r for r in mix_digest(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[k].target for k in (1, 2, 4)] == [9.0, 15.0, 0.0] and got[5].target == 120.0
    assert abs(sum(r.target for r in got.values()) - 1448) < 1e-6


def test_many_sources_are_joined_salted(spark, monkeypatch):
    rows = odd_rows()
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 2)
    agrees(mix_digest(df).collect(), plain_mix(rows))


def test_the_mix_repeats_rows_and_keeps_columns(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, DOCS).withColumn("rows", F.lit(1)).withColumn("last", F.lit("mine")).withColumn("_key", F.lit(2)).withColumn("Size", F.lit("gone"))
    out = mix_sources(df)
    assert out.columns == ["doc_id", "text", "source", "rows", "last", "_key", "size", "source_size", "target", "taken"]
    assert {(r["rows"], r["last"], r["_key"]) for r in out.collect()} == {(1, "mine", 2)}
    agrees([(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in out.collect()], plain_mix(rows))
    times = Counter(r.text for r in mixed(df).collect())
    want = Counter()
    for r in out.collect():
        want[r.text] += r.taken // r["size"] if r["size"] else 0
    assert times == +want


def test_heavier_documents_come_first(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") < 3600, "a").otherwise("b").alias("source"))
    got = mix_sources(docs, weights=(1, 9), quality=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).where("source = 'a'")
    n = {r["even"]: r["n"] for r in got.where("taken > 0").groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.count("*").alias("n")).collect()}
    assert n[True] > 1.2 * n[False] and got.where("taken > size").count() > 0 or n[True] > 1.2 * n[False]


def test_empty_table(spark):
    got = mix_digest(spark.createDataFrame([], DOCS))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and got.count() == 0
