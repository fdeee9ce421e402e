"""All pairs over a threshold against brute force, and how few of them are scored."""

import numpy as np
import pytest

from tessera.operators.similar import classes, similar_pairs

ROWS = "vec_id long, embedding array<double>"


def brute(rows, threshold):
    first = {}
    for i, v in sorted((r for r in rows if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])), key=lambda r: r[0]):
        first.setdefault(tuple(x + 0.0 for x in v), i)
    reps = [(i, np.array(v)) for v, i in first.items()]
    return {(min(a, b), max(a, b)) for k, (a, x) in enumerate(reps) for b, y in reps[:k] if len(x) == len(y) and (x * y).sum() >= threshold}


def clustered(n, groups, spread, d=16, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, d))
    x = middle[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("part", [7, 4096])
@pytest.mark.parametrize("threshold", [0.3, 0.7])
def test_pairs_equal_brute_force(spark, part, threshold):
    x = clustered(150, 6, 0.4)
    x[:40] *= np.linspace(0.2, 3, 40)[:, None]  # vectors of many lengths
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(200 + k, x[k % 3].tolist()) for k in range(20)]
    rows += [(None, x[0].tolist()), (300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [None] + [1.0] * 15), (305, [1.0, 1.0]), (306, [2.0, 0.0]), (307, [-0.0, 2.0])]
    got, _ = similar_pairs(spark.createDataFrame(rows, ROWS).repartition(3), threshold, part=part)
    pairs = [(r.a, r.b) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(rows, threshold)


def test_few_pairs_are_scored(spark):
    x = clustered(4000, 80, 0.05, d=32)
    got, scored = similar_pairs(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], ROWS), 0.9)
    want = np.triu(x @ x.T >= 0.9, 1).sum()
    assert got.count() == want and scored < len(x) ** 2 / 2 / 8


def test_copies_are_one_class(spark):
    rows = [(k, [1.0, 0.0]) for k in range(5000)] + [(9000, [0.9, 0.1]), (9001, [0.0, 1.0])]
    df = spark.createDataFrame(rows, ROWS)
    got, scored = similar_pairs(df, 0.5)
    assert [(r.a, r.b) for r in got.collect()] == [(0, 9000)] and scored < 20
    assert {r.rep_id: len(r.vec_ids) for r in classes(df).collect()} == {0: 5000, 9000: 1, 9001: 1}


def test_nothing_to_compare(spark):
    got, scored = similar_pairs(spark.createDataFrame([], ROWS), 0.5)
    assert got.count() == 0 and scored == 0
    assert similar_pairs(spark.createDataFrame([(1, [1.0]), (2, None)], ROWS), 0.5)[0].count() == 0
    with pytest.raises(ValueError):
        similar_pairs(spark.createDataFrame([(1, [1.0])], ROWS), 0.0)


def test_copies_of_a_vector_grow_with_groups_and_not_with_cells(spark, monkeypatch):
    """Vectors without structure, which may match in every cell: each is sent to a part of the groups, not to each cell."""
    frame, sent = type(spark.range(0)), []
    repartition = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: (sent.append(self), repartition(self, *a))[1])
    x = np.random.default_rng(3).normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], ROWS)
    got, _ = similar_pairs(rows, 0.5)
    assert got.count() == np.triu(x @ x.T >= 0.5, 1).sum()
    assert sent[0].count() < 40 * len(x)


def test_each_pair_of_groups_meets_once_and_evenly():
    from tessera.operators.similar import grouped, turn

    n = np.arange(9)
    goes = turn(n[:, None], n[None])
    assert (goes ^ goes.T | np.eye(9, dtype=bool)).all() and goes.diagonal().all() and set(goes.sum(0)) == {5}
    size = np.array([3, 4, 5, 20, 1, 9, 9, 2])
    group = grouped(size, 10)
    assert group.tolist() == [0, 0, 1, 2, 3, 3, 4, 5]


@pytest.mark.parametrize("block", [3, 8192])
def test_matches_equal_plain_loops(spark, block):
    """Odd vectors as ``dot`` has them; blocks of queries; no product of two arrays is left to the plan."""
    from pyspark.sql import functions as F

    from tessera.operators.vectors import matches_over

    inf, nan = float("inf"), float("nan")
    x = clustered(60, 4, 0.5, d=8)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(10, x[11].tolist()), (None, x[0].tolist()), (100, None), (101, []), (110, []), (120, [1.0, None]), (130, [1.0, 1.0]), (131, [0.3, 0.2]), (132, [0.1, 0.1])]
    rows += [(140, [nan, 1.0]), (150, [inf, 1.0]), (151, [-inf, 1.0]), (160, [1e200] * 8), (161, [-1e200] * 8), (170, [1e-200] * 8)]

    def dot(a, b):
        if a is None or b is None or len(a) != len(b) or None in a + b:
            return None
        s = 0.0
        for p, q in zip(a, b):
            s += p * q
        return s

    want = sorted((i, k, repr(s)) for i, q in rows if i is not None and i % 10 == 0 for k, v in rows if k is not None and k != i and (s := dot(q, v)) is not None and not s < 0.5)
    found = matches_over(spark.createDataFrame(rows, ROWS).repartition(3), F.col("vec_id") % 10 == 0, 0.5, block=block)
    assert sorted((r.query_id, r.vec_id, repr(r.score)) for r in found.collect()) == want and len(want) > 50
    assert "zip_with" not in found._jdf.queryExecution().toString()
