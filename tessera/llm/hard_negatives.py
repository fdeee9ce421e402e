"""Hard negatives: for each anchor a full sort of integer scores, read below each positive's own score.

Rows are brought into blocks of ``BLOCK`` vectors, by their tasks as they come, so that no key can make a block large; blocks
are dealt into parts. Every anchor comes to every part (a stated set of queries against all rows, in blocks). There its
integer scores with all rows of the part are computed and sorted, by score, then id (``lexsort``). Twice: first each part gives its best
rows of the anchor's label, of which the best of all parts are the positives. Then anchors come with these; in the sorted
scores each positive's upper limit is found by binary search, and from there on the rows of other labels are read, k of them, as
long as they are above the lower limit. The best k of all parts are the answer: whatever is among them is among the best k of its
part. Parts give a few rows an anchor, so neither an anchor's scores nor a label's rows are ever brought together.

Defined cases: rows with a null id, label or vector, or with null or non-finite components take no part; components are cut to 2**26 in
amount; vectors are compared with those of their own length; rows with the anchor's own id are never its positives; repeated rows are
candidates each, while equal anchors are one; an anchor without positives or negatives has no rows; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrays import one_array
from tessera.llm.tables import in_arrow, stored
from tessera.llm.vector_blocks import chunks, finite, integers, matrix, products

BLOCK = 8192
PART_BLOCKS = 4  #: blocks of a part, on average, where the session's shuffle partitions are fewer
ANCHORS_AT_ONCE = 64


def row_blocks(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, label, v) in blocks of vectors of one length: d, ids, labels, x (bytes)."""

    def blocked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(it, BLOCK):
            size = np.diff(one_array(table.column("v")).offsets.to_numpy())
            for d in np.unique(size).tolist():
                own = table.take(pa.array(np.flatnonzero(size == d)))
                x = matrix(own.column("v"), d).astype(np.int32)
                blobs = [own.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([b], pa.binary()) for b in (*blobs, x.tobytes()))], names=["d", "ids", "labels", "x"])

    return in_arrow(rows, blocked, "d int, ids binary, labels binary, x binary")


def by_score(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order of a full sort: higher scores first, ties by smaller id."""
    return np.lexsort((ids, -score))


def best_positives(score: np.ndarray, ids: np.ndarray, same: np.ndarray, k: int) -> np.ndarray:
    """Rows of the anchor's label, the best k."""
    on = np.flatnonzero(same)
    return on[by_score(score[on], ids[on])[:k]]


def in_the_band(score: np.ndarray, ids: np.ndarray, other: np.ndarray, positives: np.ndarray, share: tuple[int, int], k: int) -> list[tuple[int, np.ndarray]]:
    """For each positive's score: its number, and the first k rows of other labels from it down to its lower limit."""
    on = np.flatnonzero(other)
    on = on[by_score(score[on], ids[on])]
    falling = -score[on]
    out = []
    for n, own in enumerate(positives.tolist()):
        begin = int(np.searchsorted(falling, -own, "left"))
        end = int(np.searchsorted(falling, -share[0] * own // share[1], "right"))  # scores of at least share of the positive's
        if end > begin:
            out.append((n, on[begin : min(end, begin + k)]))
    return out


def hard_negatives(vectors: DataFrame, is_anchor: Column | str, label: Column | str = "label", positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    A negative's score is between share[0] / share[1] of the positive's and the positive's.
    """
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    v, mark = F.col(vector), F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor
    rows = vectors.where(finite(v)).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), integers(v).alias("v"), F.coalesce(mark, F.lit(False)).alias("asks")).where("vec_id is not null and label is not null")
    blocks = stored(row_blocks(rows.select("vec_id", "label", "v")).withColumn("n", F.monotonically_increasing_id()), "vector-blocks")
    asked = rows.where("asks").select("vec_id", "label", "v").distinct()
    anchors = stored(asked.select(F.xxhash64("vec_id", "label", "v").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v"), "anchors")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(blocks.count() / PART_BLOCKS))
    dealt = blocks.select(F.pmod(F.xxhash64("n"), F.lit(parts)).alias("part"), F.lit(False).alias("asks"), "d", "ids", "labels", "x", *[F.lit(None).cast(t).alias(c) for c, t in (("anchor", "long"), ("anchor_id", "long"), ("label", "long"), ("v", "array<int>"), ("scores", "array<long>"))])

    def scored(asking: DataFrame, found, kinds: str) -> DataFrame:
        """What ``found`` gives for each anchor (anchor, anchor_id, label, v, scores) and the rows of a part."""
        everywhere = asking.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(True).alias("asks"), F.size("v").alias("d"), *[F.lit(None).cast("binary").alias(c) for c in ("ids", "labels", "x")], "anchor", "anchor_id", "label", "v", "scores")

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by part and length, first the blocks, then anchors."""
            here, held, ready = None, [], None
            for batch in it:
                part, d, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "d", "asks"))
                edge = np.flatnonzero((part[1:] != part[:-1]) | (d[1:] != d[:-1]) | (asks[1:] != asks[:-1])) + 1
                for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(part)]):
                    if lo == hi:
                        continue
                    some = batch.slice(lo, hi - lo)
                    if (part[lo], d[lo]) != here:
                        here, held, ready = (part[lo], d[lo]), [], None
                    if not asks[lo]:
                        held.extend(zip(*(some.column(c).to_pylist() for c in ("ids", "labels", "x"))))
                        continue
                    if held and ready is None:
                        ready = [np.frombuffer(b"".join(b[c] for b in held), t) for c, t in ((0, np.int64), (1, np.int64), (2, np.int32))]
                        ready[2] = ready[2].astype(np.int64).reshape(len(ready[0]), int(d[lo]))
                        held = [()]
                    if ready is not None:
                        for k in range(0, len(some), ANCHORS_AT_ONCE):
                            own = some.slice(k, ANCHORS_AT_ONCE)
                            yield found(own, products(matrix(own.column("v"), int(d[lo])), ready[2]), *ready[:2])

        both = dealt.unionByName(everywhere).repartition(parts, "part").sortWithinPartitions("part", "d", "asks")
        return in_arrow(both, batches, kinds)

    def take(own: pa.RecordBatch, picked: list[tuple[int, int, np.ndarray]], score: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        """Rows (anchor, nth positive, id, score) of what was picked: place of the anchor, nth and rows."""
        at = np.repeat([p[0] for p in picked], [len(p[2]) for p in picked]).astype(np.int64)
        nth = np.repeat([p[1] for p in picked], [len(p[2]) for p in picked]).astype(np.int32)
        row = np.concatenate([p[2] for p in picked]) if picked else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([own.column("anchor").take(pa.array(at)), pa.array(nth), pa.array(ids[row]), pa.array(score[at, row])], names=["anchor", "nth", "vec_id", "score"])

    def sought(own: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
        return enumerate(zip(own.column("anchor_id").to_pylist(), own.column("label").to_pylist()))

    def same_label(own: pa.RecordBatch, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
        return take(own, [(n, 0, best_positives(score[n], ids, (labels == mine) & (ids != a), positives)) for n, (a, mine) in sought(own)], score, ids)

    def other_label(own: pa.RecordBatch, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
        limits = own.column("scores").to_pylist()
        return take(own, [(n, nth, rows) for n, (_, mine) in sought(own) for nth, rows in in_the_band(score[n], ids, labels != mine, np.array(limits[n], np.int64), share, negatives)], score, ids)

    kinds = "anchor long, nth int, vec_id long, score long"
    best = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "vec_id")
    near = scored(anchors.withColumn("scores", F.lit(None).cast("array<long>")), same_label, kinds)
    chosen = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    in_order = F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score")))
    chosen = stored(chosen.groupBy("anchor").agg(in_order.alias("positives")), "positives")
    asking = anchors.join(chosen, "anchor").withColumn("scores", F.col("positives.score"))
    far = scored(asking.drop("positives"), other_label, kinds)
    far = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = asking.select("anchor", "anchor_id", F.posexplode("positives").alias("nth", "p"))
    return far.join(named, ["anchor", "nth"]).select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.rank").alias("positive_rank"), "rank", F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def negatives_digest(vectors: DataFrame) -> DataFrame:
    """Anchors are rows whose id is divisible by 100; where it is divisible by 7, the label is the next of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, moved).drop("positive_rank")
