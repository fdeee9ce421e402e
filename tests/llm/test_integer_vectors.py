"""Centroid clusters and hard negatives against plain loops over integers."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, hard_negatives, queries
from tessera.llm.ann import nearest
from tessera.llm.centroids import Tree, centroid_clusters, cluster_digest
from tessera.llm.hard_negatives import negatives_digest
from tessera.llm.vector_blocks import products

SF = "/root/testdata/sf0.01"
ROWS = "vec_id long, embedding array<double>, label int, v string, cluster int"


def vector_rows(d=64):
    rng = random.Random(8)
    places = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    rows = []
    for k in range(400):
        spread = rng.choice((0.01, 0.3, 0.0))
        rows.append((k, [x + rng.gauss(0, spread) if spread else x for x in rng.choice(places)], rng.randrange(10)))
    rows += [(k % 5, rows[k % 5][1], rows[k % 5][2]) for k in range(200)]  # copies, of few ids
    rows += [(500 + k, places[0], 3) for k in range(150)]
    rows += [(None, places[1], 2), (700, None, 1), (701, [], 1), (702, [1.0] * (d - 1), 4), (703, [float("nan")] * d, 1), (704, [None] + [0.0] * (d - 1), 2)]
    rows += [(705, [float("inf")] * d, 1), (800, [0.0] * d, None), (900, [-0.5] * d, 5), (1000, [0.0] * d, 6), (1100, [1e300] + [0.0] * (d - 1), 7)]
    return [(*r, "mine", 3) for r in rows]


def as_integers(x):
    return [math.floor(max(-float(1 << 26), min(float(1 << 26), 256 * float(c)))) for c in x]


def usable(rows, length=None):
    return [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1]) and length in (None, len(r[1]))]


def plain_clusters(rows, k=40, rounds=5):
    kept = [(r[0], as_integers(r[1])) for r in usable(rows, 64)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in start]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        at = nearest()
        for j in range(len(cents)):
            own = [v for (_, v), (_, n) in zip(kept, at) if n == j]
            if own:
                cents[j] = [sum(c) // len(own) for c in zip(*own)]
    at = nearest()
    inertia = Counter()
    for d, j in at:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, at))


@pytest.mark.parametrize("chunk", [50, 4096])
def test_clusters_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(centroids, "CHUNK", chunk)
    rows = vector_rows()
    got = cluster_digest(spark.createDataFrame(rows, ROWS).repartition(3))
    assert Counter(tuple(r) for r in got.collect()) == plain_clusters(rows)


def test_few_vectors_and_none(spark):
    rows = vector_rows()[:3]
    assert Counter(tuple(r) for r in cluster_digest(spark.createDataFrame(rows, ROWS)).collect()) == plain_clusters(rows)
    none = cluster_digest(spark.createDataFrame([], ROWS))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0
    assert centroid_clusters(spark.createDataFrame(rows, ROWS), dimensions=3)[0].count() == 0


def test_balls_are_assigned_whole():
    rng = np.random.default_rng(2)
    places = rng.integers(-2000, 2000, (40, 64))
    x = places[rng.integers(0, 40, 4096)] + rng.integers(-3, 4, (4096, 64))
    tree = Tree(x)
    cluster, count, sums, compared = tree.assign(places)
    want = ((tree.x[:, None] - places[None]) ** 2).sum(2).argmin(1)
    assert np.array_equal(cluster, want) and compared < len(x) / 2
    assert np.array_equal(count, np.bincount(want, minlength=40))
    assert all(np.array_equal(sums[j], tree.x[want == j].sum(0)) for j in range(40))
    far = (np.sqrt(((tree.x[a:b] - m) ** 2).sum(1)).max() for a, b, m in zip(tree.lo, tree.hi, tree.middle()))
    assert np.allclose(list(far), tree.radius)


def test_ties_go_to_the_smaller_number():
    tree = Tree(np.zeros((100, 2), np.int64))
    assert set(tree.assign(np.array([[5, 0], [0, 5], [3, 4], [-5, 0]]))[0].tolist()) == {0}


def test_products_are_exact():
    big = np.full((2, 64), 1 << 26, np.int64)
    assert products(big, big).tolist() == [[64 << 52] * 2] * 2 and products(big - 1, big).tolist() == [[64 * ((1 << 26) - 1) << 26] * 2] * 2


def plain_negatives(rows):
    kept = []
    for i, v, label, *_ in usable(rows):
        if i is not None and label is not None:
            kept.append((i, as_integers(v), (label + 1) % 10 if i % 7 == 0 else label))
    out = Counter()
    for a, v, label in {(i, tuple(v), label) for i, v, label in kept if i % 100 == 0}:
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, other) for i, w, other in kept if len(w) == len(v))
        for s, i, _ in [x for x in scored if x[2] == label and x[1] != a][:5]:
            found = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            for rank, (t, n, _) in enumerate(found, 1):
                out[a, i, rank, n, -s, -t] += 1
    return out


@pytest.mark.parametrize("block", [7, 8192])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = vector_rows()
    got = negatives_digest(spark.createDataFrame(rows, ROWS).repartition(3))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows)
    assert len(want) > 20 and Counter(tuple(r) for r in got.collect()) == want


def test_negatives_of_an_empty_table(spark):
    assert negatives_digest(spark.createDataFrame([], ROWS)).count() == 0


@pytest.mark.parametrize("name", ["op12_centroids", "op13_hard_negatives"])
def test_whole_tables_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(result.fetchall())


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1.0])
def test_neighbours_of_extreme_norms(spark, scale):
    """Fewer candidates than k are all returned, however large or small their products are."""
    rng = random.Random(4)
    rows = [(k, [scale * rng.gauss(0, 1) for _ in range(4)]) for k in range(12)] + [(20, [0.0] * 4)]
    got = {(r.query_id, r.vec_id): r.score for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()}
    assert set(got) == {(0, k) for k in range(1, 12)}
    with np.errstate(over="ignore", invalid="ignore"):
        want = {k: float((np.array(rows[0][1]) * np.array(rows[k][1])).sum()) for k in range(1, 12)}
    assert all(got[0, k] == (-math.inf if math.isnan(x) else x) or abs(got[0, k] - x) <= 1e-12 * abs(x) for k, x in want.items())


def test_neighbours_need_integer_ids(spark):
    with pytest.raises(ValueError, match="integer"):
        nearest(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"), F.lit(True))
