"""Suppression in rounds against a plain greedy loop."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import detection
from tessera.operators.detection import suppressed_boxes, suppressed_in_rounds

BOXES = "img int, vec_id long, score double, x1 double, y1 double, x2 double, y2 double"


def overlap(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda c: max(0, c[2] - c[0]) * max(0, c[3] - c[1])
    union = area(a) + area(b) - w * h
    return w * h / union if union > 0 else 0


def greedy(rows, threshold):
    out = set()
    for img in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == img), key=lambda r: (-r[2], r[1])):
            if not any(overlap(k[3:], r[3:]) > threshold for k in kept):
                kept.append(r)
        out |= {(img, r[1], n) for n, r in enumerate(kept)}
    return out


@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.4, 0.9])
def test_rounds_equal_the_greedy_loop(spark, threshold):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        x, y, w, h = rng.randrange(200), rng.randrange(200), rng.choice((0, 10, 40, 90)), rng.choice((5, 30, 80))
        rows.append((k % 3, k, rng.choice((0.5, 0.6, 0.7, rng.random())), float(x), float(y), float(x + w), float(y + h)))
    rows += [(7, k, 0.9 - k / 100, 5.0 * k, 0.0, 5.0 * k + 10, 10.0) for k in range(40)]  # a chain: each overlaps the next
    rows += [(8, k, 0.5, 0.0, 0.0, 10.0, 10.0) for k in range(30)]  # ties: equal boxes and scores
    df = spark.createDataFrame(rows, BOXES).repartition(4)
    got = {tuple(r) for r in suppressed_in_rounds(df, threshold).collect()}
    assert got == greedy(rows, threshold) == {tuple(r) for r in suppressed_boxes(df, threshold).collect()}


def test_golden_chain(spark):
    rows = [(0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 1, 0.8, 4.0, 0.0, 14.0, 10.0), (0, 2, 0.7, 8.0, 0.0, 18.0, 10.0)]  # the middle one goes, and suppresses nothing
    assert {r.vec_id for r in suppressed_in_rounds(spark.createDataFrame(rows, BOXES), 0.4).collect()} == {0, 2}


def test_one_image_of_very_many_boxes(spark):
    n = 200_000
    h = lambda k, m: F.pmod(F.xxhash64(F.lit(k), F.col("vec_id")), F.lit(m))
    boxes = spark.range(n).withColumnRenamed("id", "vec_id").select(F.lit(1).alias("img"), "vec_id", (h(0, 10_000) / 10_000).alias("score"), (h(1, 20_000) * 1.0).alias("x1"), (h(2, 20_000) * 1.0).alias("y1"))
    boxes = detection.written(boxes.withColumns({"x2": F.col("x1") + 20 + h(3, 40), "y2": F.col("y1") + 20 + h(4, 40)}), "boxes")
    kept = detection.written(suppressed_in_rounds(boxes, 0.3).drop("place"), "kept")
    best = boxes.join(kept, ["img", "vec_id"])
    pairs = detection.met_boxes(best, 64).where(detection.intersection_over_union(F.col("p"), F.col("q")) > 0.3)
    assert pairs.count() == 0  # no kept box overlaps another
    lost = detection.met_boxes(boxes, 64, "score").where(detection.intersection_over_union(F.col("p"), F.col("q")) > 0.3)
    both = lost.select(F.explode(F.array(F.struct(F.col("p").alias("a"), F.col("q").alias("b")), F.struct(F.col("q").alias("a"), F.col("p").alias("b")))).alias("e")).select("e.*")
    better = both.where((F.col("b.score") > F.col("a.score")) | ((F.col("b.score") == F.col("a.score")) & (F.col("b.vec_id") < F.col("a.vec_id"))))
    answered = better.join(kept.select(F.col("vec_id").alias("k")), F.col("b.vec_id") == F.col("k"), "left_semi").select(F.col("a.vec_id").alias("vec_id")).distinct()
    gone = boxes.join(kept, ["img", "vec_id"], "left_anti")
    assert gone.count() == n - kept.count() > 1000 and gone.join(answered, "vec_id", "left_anti").count() == 0  # each that went has a better kept one over it


def test_nothing_and_odd_scores(spark):
    assert suppressed_in_rounds(spark.createDataFrame([], BOXES), 0.4).count() == 0
    rows = [(0, 0, None, 0.0, 0.0, 10.0, 10.0), (0, 1, float("nan"), 0.0, 0.0, 10.0, 10.0), (0, 2, 0.1, 1.0, 0.0, 10.0, 10.0), (1, 3, None, 0.0, 0.0, 1.0, 1.0)]
    assert {(r.img, r.vec_id) for r in suppressed_in_rounds(spark.createDataFrame(rows, BOXES), 0.4).collect()} == {(0, 2), (1, 3)}
    with pytest.raises(ValueError):
        suppressed_in_rounds(spark.createDataFrame(rows, BOXES), -0.1)
