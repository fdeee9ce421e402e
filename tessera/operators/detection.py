"""Detector post-processing: anchors, boxes, overlap, suppression, similarity fits, as column expressions; pixels in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.places import written

SIDE, STRIDES, ANCHORS = 640, (8, 16, 32), 2
#: Where the five landmarks of an upright face stand in a square of 112 pixels.
TEMPLATE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))


def anchor_grid(spark: SparkSession, side: int = SIDE, strides: tuple[int, ...] = STRIDES) -> DataFrame:
    """stride, anchor (number in row-major order, pairs together), cx, cy."""
    heads = None
    for s in strides:
        n = -(-side // s)
        cell = F.floor(F.col("id") / ANCHORS)
        one = spark.range(n * n * ANCHORS).select(F.lit(s).alias("stride"), F.col("id").alias("anchor"), (cell % n * s).cast("double").alias("cx"), (F.floor(cell / n) * s).cast("double").alias("cy"))
        heads = one if heads is None else heads.unionByName(one)
    return heads


def decode_boxes(raw: DataFrame, anchors: DataFrame, least_score: float = 0.5) -> DataFrame:
    """raw (img, stride, anchor, score, l, t, r, b, kps) with boxes x1, y1, x2, y2 and ``landmarks``, of scores from ``least_score`` on.

    kps are five pairs of distances, landmarks their places. A row beyond the anchors of its stride is an error. The
    anchors are a constant table of 16,800 rows at most.
    """
    s = F.col("stride")
    near = raw.where(F.col("score") >= least_score).join(F.broadcast(anchors), ["stride", "anchor"], "left")
    cx = F.when(F.col("cx").isNull(), F.raise_error(F.concat(F.lit("no anchor "), F.col("anchor").cast("string"), F.lit(" at stride "), s.cast("string")))).otherwise(F.col("cx"))
    near = near.withColumn("cx", cx.cast("double"))
    marks = F.transform("kps", lambda d, k: F.when(k % 2 == 0, F.col("cx")).otherwise(F.col("cy")) + d * s)
    own = [c for c in raw.columns if c not in ("stride", "anchor", "score", "l", "t", "r", "b", "kps", "img")]
    return near.select("img", "stride", "anchor", "score", *[(F.col(c) + sign * F.col(d) * s).alias(n) for n, c, sign, d in (("x1", "cx", -1, "l"), ("y1", "cy", -1, "t"), ("x2", "cx", 1, "r"), ("y2", "cy", 1, "b"))], marks.alias("landmarks"), *own)


def detections(raw: DataFrame, anchors: DataFrame, least_score: float = 0.5, threshold: float = 0.4) -> DataFrame:
    """Decoded boxes of all strides after one suppression across them: img, vec_id, place (from 0)."""
    return suppressed_boxes(decode_boxes(raw, anchors, least_score), threshold)


def tensor_kind(dims: Column, side: int = SIDE) -> dict[str, Column]:
    """What a detector's output is, by its shape (rows, columns; a leading 1 is dropped): kind and stride, null if unknown."""
    two = F.when((F.size(dims) == 3) & (F.get(dims, F.lit(0)) == 1), F.slice(dims, 2, 2)).otherwise(dims)
    fits = F.size(two) == 2
    rows, wide = F.get(two, F.lit(0)), F.get(two, F.lit(1))
    kind = F.when(wide == 1, "score").when(wide == 4, "box").when(wide == 10, "landmarks")
    stride = F.coalesce(*[F.when(rows == (-(-side // s)) ** 2 * ANCHORS, F.lit(s)) for s in STRIDES])
    return {"kind": F.when(fits, kind), "stride": F.when(fits, stride)}


def grouped_heads(tensors: DataFrame) -> DataFrame:
    """img, stride, score, box, landmarks: the ids of the tensors (img, tensor_id, dims) by stride and kind.

    A tensor of unknown shape and a stride without all three kinds are errors.
    """
    known = tensor_kind(F.col("dims"))
    typed = tensors.select("img", "tensor_id", known["kind"].alias("kind"), known["stride"].alias("stride"))
    odd = F.when(F.col("kind").isNull() | F.col("stride").isNull(), F.raise_error(F.lit("a tensor of unknown shape"))).otherwise(F.col("kind"))
    wide = typed.withColumn("kind", odd.cast("string")).groupBy("img", "stride").pivot("kind", ["score", "box", "landmarks"]).agg(F.min("tensor_id"))
    whole = F.col("score").isNotNull() & F.col("box").isNotNull() & F.col("landmarks").isNotNull()
    return wide.withColumn("score", F.when(whole, F.col("score")).otherwise(F.raise_error(F.lit("an incomplete stride")).cast("long")))


def unletterboxed(boxes: DataFrame, scale: Column) -> DataFrame:
    """Boxes x1, y1, x2, y2 of the detector's square as x, y, w, h in the picture."""
    x1, y1, x2, y2 = (F.col(c) / scale for c in ("x1", "y1", "x2", "y2"))
    return boxes.withColumns({"x": x1, "y": y1, "w": x2 - x1, "h": y2 - y1}).drop("x1", "y1", "x2", "y2")


def intersection_over_union(a: Column, b: Column) -> Column:
    """Of two boxes with fields x1, y1, x2, y2; 0 for a shared edge and for no area."""
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))

    def area(box: Column) -> Column:
        return F.greatest(zero, box["x2"] - box["x1"]) * F.greatest(zero, box["y2"] - box["y1"])

    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def corners(boxes: DataFrame) -> DataFrame:
    """x, y, w, h as x1, y1, x2, y2."""
    return boxes.withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h")})


def met_boxes(boxes: DataFrame, cell: int, *carried: str) -> DataFrame:
    """img, p and q (structs of vec_id, x1, y1, x2, y2 and what is carried; p's id is the smaller): boxes of an image that overlap, once each.

    Boxes meet only where they cover the same cell of a grid; a pair counts in the cell of its common corner.
    """

    def cells(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))

    box = F.struct("vec_id", "x1", "y1", "x2", "y2", *carried)
    filed = boxes.where("x2 > x1 and y2 > y1").select("img", box.alias("box"), "x1", "x2", "y1", "y2").withColumn("gx", cells("x1", "x2")).withColumn("gy", cells("y1", "y2"))
    left, right = (filed.select("img", "gx", "gy", F.col("box").alias(n)) for n in "pq")
    here = (F.col("gx") == F.floor(F.greatest("p.x1", "q.x1") / cell)) & (F.col("gy") == F.floor(F.greatest("p.y1", "q.y1") / cell))
    touch = (F.col("p.x1") < F.col("q.x2")) & (F.col("q.x1") < F.col("p.x2")) & (F.col("p.y1") < F.col("q.y2")) & (F.col("q.y1") < F.col("p.y2"))
    return left.join(right, ["img", "gx", "gy"]).where((F.col("p.vec_id") < F.col("q.vec_id")) & here & touch).select("img", "p", "q")


def overlapping_pairs(boxes: DataFrame, least: float, cell: int = 64) -> DataFrame:
    """img, a, b (vec_id, a < b), iou: pairs of an image whose overlap is over ``least`` (0 or more)."""
    if least < 0:
        raise ValueError("boxes that don't touch aren't looked at")
    met = met_boxes(corners(boxes), cell)
    return met.select("img", F.col("p.vec_id").alias("a"), F.col("q.vec_id").alias("b"), intersection_over_union(F.col("p"), F.col("q")).alias("iou")).where(F.col("iou") > least)


def suppressed_in_rounds(boxes: DataFrame, threshold: float = 0.4, cell: int = 64) -> DataFrame:
    """``suppressed_boxes`` (boxes: img, vec_id, score, x1, y1, x2, y2) without one fold an image: img, vec_id, place.

    Pairs that overlap by over the threshold are edges from the better box to the worse one (score, then the smaller vec_id).
    A box that no edge leads to stays, and the boxes that its edges lead to go, with all edges of these. That is repeated until no
    edge is left, so each round settles all images at once; a round takes the best of what is left in every chain of overlaps. Ids are
    distinct in an image; a score that is null or no number counts as the lowest.
    """
    if threshold < 0:
        raise ValueError("boxes that don't touch aren't looked at")
    ranked = boxes.withColumn("_score", F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(float("-inf"))), F.lit(float("-inf"))))
    met = met_boxes(ranked, cell, "_score").where(intersection_over_union(F.col("p"), F.col("q")) > threshold)
    first = F.col("p._score") >= F.col("q._score")  # p has the smaller id
    better, worse = (F.when(first, F.col(f"{m}.vec_id")).otherwise(F.col(f"{n}.vec_id")) for m, n in ("pq", "qp"))
    edges = written(met.select("img", better.alias("better"), worse.alias("worse")), "overlaps")
    gone = None
    while edges.limit(1).count():
        tops = edges.select("img", "better").join(edges.select("img", F.col("worse").alias("better")), ["img", "better"], "left_anti").distinct()
        out = written(edges.join(tops, ["img", "better"], "left_semi").select("img", "worse").distinct(), "suppressed")
        gone = out if gone is None else gone.unionByName(out)
        left = edges.join(out, ["img", "worse"], "left_anti").join(out.withColumnRenamed("worse", "better"), ["img", "better"], "left_anti")
        edges = written(left.select("img", "better", "worse"), "overlaps")
    kept = ranked if gone is None else ranked.join(gone.withColumnRenamed("worse", "vec_id"), ["img", "vec_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("img").orderBy(F.desc("_score"), "vec_id")) - 1
    return kept.select("img", "vec_id", place.alias("place"))


def suppressed(boxes: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Greedy suppression per image: img, vec_id of boxes that stay, and their ``place`` (from 0).

    Best score first, ties by vec_id; a box goes if its overlap with a kept one is over the threshold. A group is the
    boxes of one image, as many as a detector has anchors at most.
    """
    return suppressed_boxes(corners(boxes), threshold)


def suppressed_boxes(boxes: DataFrame, threshold: float) -> DataFrame:
    """``suppressed`` for boxes given as x1, y1, x2, y2."""
    one = F.struct((-F.col("score")).alias("back"), "vec_id", "x1", "y1", "x2", "y2")
    ordered = boxes.groupBy("img").agg(F.array_sort(F.collect_list(one)).alias("all"))
    none = F.filter("all", lambda b: F.lit(False))
    kept = F.aggregate("all", none, lambda acc, b: F.when(F.exists(acc, lambda k: intersection_over_union(k, b) > threshold), acc).otherwise(F.concat(acc, F.array(b))))
    return ordered.select("img", F.posexplode(kept).alias("place", "b")).select("img", F.col("b.vec_id").alias("vec_id"), "place")


def similarity_fit(points: DataFrame, key: str) -> DataFrame:
    """key, a, b, c, d, tx, ty, n: the rotation, scale and shift that best bring (sx, sy) to (dx, dy).

    Keys of fewer than two points are left out; points that coincide have a scale of 1.
    """
    p = points.groupBy(key).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in ("sx", "sy", "dx", "dy")],
        (F.covar_pop("dx", "sx") + F.covar_pop("dy", "sy")).alias("along"), (F.covar_pop("dy", "sx") - F.covar_pop("dx", "sy")).alias("across"), (F.var_pop("sx") + F.var_pop("sy")).alias("spread"),
    ).where("n >= 2")
    length = F.sqrt(F.col("along") ** 2 + F.col("across") ** 2)
    scale = F.when(F.col("spread") > 0, length / F.col("spread")).otherwise(1.0)
    angle = F.atan2("across", "along")
    p = p.withColumns({"a": scale * F.cos(angle), "c": scale * F.sin(angle)}).withColumns({"b": -F.col("c"), "d": F.col("a")})
    return p.select(key, "a", "b", "c", "d", (F.col("mdx") - F.col("a") * F.col("msx") - F.col("b") * F.col("msy")).alias("tx"), (F.col("mdy") - F.col("c") * F.col("msx") - F.col("d") * F.col("msy")).alias("ty"), "n")


def template_fit(landmarks: DataFrame, key: str) -> DataFrame:
    """``similarity_fit`` that brings five landmarks (key, landmarks: ten numbers) to the places of an upright face."""
    at = F.array(*[F.struct(F.lit(2 * k).alias("k"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for k, (x, y) in enumerate(TEMPLATE)])
    points = landmarks.select(key, "landmarks", F.explode(at).alias("p"))
    return similarity_fit(points.select(key, F.get("landmarks", F.col("p.k")).alias("sx"), F.get("landmarks", F.col("p.k") + 1).alias("sy"), "p.dx", "p.dy"), key)


def warped(images: DataFrame, side: int = 112) -> DataFrame:
    """id and ``crop``: the square that an affine map takes from an image (id, width, height, rgb, t: from the image to the square).

    Bilinear, pixel centres at halves, edges repeated, rounded to bytes; null if the map has no inverse.
    """

    @F.pandas_udf("binary")
    def crop(width: pd.Series, height: pd.Series, rgb: pd.Series, inverse: pd.DataFrame) -> pd.Series:
        out = []
        for w, h, raw, a, b, c, d, tx, ty in zip(width, height, rgb, *(inverse[k] for k in ("a", "b", "c", "d", "tx", "ty"))):
            if raw is None or pd.isna(a):
                out.append(None)
                continue
            pixels = np.frombuffer(raw, np.uint8).reshape(h, w, 3).astype(float)
            x, y = np.meshgrid(np.arange(side) + 0.5, np.arange(side) + 0.5)
            sx, sy = a * x + b * y + tx - 0.5, c * x + d * y + ty - 0.5
            x0, y0 = np.floor(sx), np.floor(sy)
            fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
            at = lambda yy, xx: pixels[np.clip(yy, 0, h - 1).astype(int), np.clip(xx, 0, w - 1).astype(int)]
            top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
            low = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
            out.append(np.floor(top * (1 - fy) + low * fy + 0.5).clip(0, 255).astype(np.uint8).tobytes())
        return pd.Series(out)

    return images.select("id", crop("width", "height", "rgb", inverted(F.col("t"))).alias("crop"))


def planes(pixels: Column, mean: float, std: float) -> Column:
    """An array of interleaved channels (r, g, b, r, ...) as planes of (value - mean) / std."""
    one = lambda k: F.transform(F.filter(pixels, lambda p, i: i % 3 == k), lambda p: (p - F.lit(mean)) / F.lit(std))
    return F.concat(one(0), one(1), one(2))


def applied(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point under an affine map with fields a, b, c, d, tx, ty."""
    return t["a"] * x + t["b"] * y + t["tx"], t["c"] * x + t["d"] * y + t["ty"]


def inverted(t: Column) -> Column:
    """The inverse map; null if the determinant is under 1e-12."""
    det = t["a"] * t["d"] - t["b"] * t["c"]
    a, b, c, d = t["d"] / det, -t["b"] / det, -t["c"] / det, t["a"] / det
    return F.when(F.abs(det) >= 1e-12, F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), (-(a * t["tx"] + b * t["ty"])).alias("tx"), (-(c * t["tx"] + d * t["ty"])).alias("ty")))
