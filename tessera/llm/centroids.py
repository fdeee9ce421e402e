"""Centroid clustering of integer vectors (Lloyd's rounds) by ball-tree filtering, exact.

Each task cuts its rows into chunks of ``CHUNK`` and builds a metric tree of each: a node halves its rows at the median
of the component that varies most, down to ``LEAF`` rows, and stores its middle, radius, count and integer sum. The
trees are written once, to the shared folder; every round reads them. A round goes down all nodes of a tree level by
level: by the triangle inequality, a centroid that is farther from a ball's middle than the nearest one by over twice the radius
can't be the nearest of any vector in it. A ball with one centroid left is assigned whole, by its count and sum; others
go on with the centroids that are left, and leaves compare each vector with these exactly, in integers. A task gives counts and
integer sums by centroid, so a round shuffles a few rows a task, and k centroids come to the driver.

Bounds are kept with some slack, so rounding never decides; ties go to the smaller number, as exact leaves see them.

Defined cases: vectors that are null, of another length than ``dimensions``, or hold null or non-finite components take no
part; components are cut to 2**26 in amount, and sums of distances beyond 63 bits are null; rows without vec_id are clustered but never starting centroids; repeated rows are
vectors each; fewer vectors than k start as many clusters; without any (an empty table) the result is empty; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import one_array
from tessera.llm.tables import in_arrow, stored
from tessera.llm.vector_blocks import chunks, finite, integers, matrix, products

CHUNK = 4096  #: vectors of a tree
LEAF = 32
NODE_FIELDS = "lo binary, hi binary, left binary, radius binary, sums binary"


class Tree:
    """Nodes over rows in the tree's order, parents before children; a node's children are ``left`` and the next one, -1 at a leaf."""

    def __init__(self, x: np.ndarray) -> None:
        self.order = np.arange(len(x))
        lo, hi, left = [0], [len(x)], [-1]
        node = 0
        while node < len(lo):
            a, b = lo[node], hi[node]
            if b - a > LEAF:
                own = x[self.order[a:b]]
                spread = own.max(0) - own.min(0)
                if spread.any():  # equal vectors are one ball of radius 0
                    mid = (b - a) // 2
                    self.order[a:b] = self.order[a:b][np.argpartition(own[:, int(spread.argmax())], mid)]
                    left[node] = len(lo)
                    lo += [a, a + mid]
                    hi += [a + mid, b]
                    left += [-1, -1]
            node += 1
        self.lo, self.hi, self.left = (np.array(c, np.int32) for c in (lo, hi, left))
        self.x = x[self.order]
        total = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(self.x, axis=0)])
        self.sums = total[self.hi] - total[self.lo]
        middle = self.middle()
        self.radius = np.array([np.sqrt(((self.x[a:b] - m) ** 2).sum(1).max()) for a, b, m in zip(lo, hi, middle)])

    def middle(self) -> np.ndarray:
        return self.sums / (self.hi - self.lo)[:, None]

    @classmethod
    def stored(cls, x: bytes, lo: bytes, hi: bytes, left: bytes, radius: bytes, sums: bytes, dimensions: int) -> "Tree":
        tree = cls.__new__(cls)
        tree.x = np.frombuffer(x, np.int32).astype(np.int64).reshape(-1, dimensions)
        tree.lo, tree.hi, tree.left = (np.frombuffer(b, np.int32) for b in (lo, hi, left))
        tree.radius, tree.sums = np.frombuffer(radius, float), np.frombuffer(sums, np.int64).reshape(-1, dimensions)
        return tree

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The centroid of each row (in the tree's order), counts and sums by centroid, and rows that were compared one by one."""
        k = len(centroids)
        cluster, count, sums = np.zeros(len(self.x), np.int64), np.zeros(k, np.int64), np.zeros((k, self.x.shape[1]), np.int64)
        compared, middle = 0, self.middle()
        norms = (centroids**2).sum(1)
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
        while len(nodes):
            gap = middle[nodes][:, None] - centroids[None] if len(nodes) * k < 1 << 12 else None
            far = np.sqrt((gap**2).sum(2)) if gap is not None else np.sqrt(np.maximum(0, (middle[nodes] ** 2).sum(1)[:, None] - 2 * middle[nodes] @ centroids.T + norms[None]))
            scale = np.sqrt((middle[nodes] ** 2).sum(1) + norms.max())
            reach = np.where(open_, far, np.inf).min(1) + 2 * self.radius[nodes]
            open_ = open_ & (far <= (reach + 1e-6 * (1 + scale))[:, None])  # roots of rounded differences are off by 1e-8 of the scale at most
            single = open_.sum(1) == 1
            for n, j in zip(nodes[single].tolist(), open_[single].argmax(1).tolist()):
                cluster[self.lo[n] : self.hi[n]] = j
                count[j] += self.hi[n] - self.lo[n]
                sums[j] += self.sums[n]
            leaf = ~single & (self.left[nodes] < 0)
            for n, some in zip(nodes[leaf].tolist(), open_[leaf]):
                rows, own = slice(self.lo[n], self.hi[n]), np.flatnonzero(some)
                x = self.x[rows]
                best = own[(norms[own] - 2 * products(x, centroids[own])).argmin(1)]  # of |x - c|^2 what depends on c, in integers
                cluster[rows] = best
                compared += len(x)
                np.add.at(count, best, 1)
                np.add.at(sums, best, x)
            inner = ~single & ~leaf
            nodes = np.stack([self.left[nodes[inner]], self.left[nodes[inner]] + 1], 1).ravel().astype(np.int64)
            open_ = np.repeat(open_[inner], 2, axis=0)
        return cluster, count, sums, np.int64(compared)


def ball_trees(kept: DataFrame, dimensions: int) -> DataFrame:
    """Trees of a table's vectors (vec_id, v): ids, vectors in the tree's order, and its nodes."""
    key = kept.schema["vec_id"].dataType.simpleString()

    def built(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(it, CHUNK):
            tree = Tree(matrix(table.column("v"), dimensions))
            ids = one_array(table.column("vec_id")).take(pa.array(tree.order))
            blobs = [a.tobytes() for a in (tree.x.astype(np.int32), tree.lo, tree.hi, tree.left, tree.radius, tree.sums)]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([b], pa.binary()) for b in blobs)], names=["ids", "x", *NODE_FIELDS.replace(" binary", "").split(", ")])

    return stored(in_arrow(kept, built, f"ids array<{key}>, x binary, {NODE_FIELDS}"), "ball-trees")


def trees_in(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[pa.Array, Tree]]:
    for k in range(batch.num_rows):
        yield batch.column("ids").slice(k, 1).flatten(), Tree.stored(*(batch.column(c)[k].as_py() for c in range(1, batch.num_columns)), dimensions)


def round_sums(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, count, compared and sums of each task's vectors by nearest centroid."""

    def moved(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, compared = np.zeros(len(centroids), np.int64), np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in it:
            for _, tree in trees_in(batch, centroids.shape[1]):
                _, n, s, c = tree.assign(centroids)
                count, sums = count + n, sums + s
                compared[0] += c
        full = np.flatnonzero(count + compared)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * centroids.shape[1], pa.int32()), pa.array(sums[full].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(count[full]), pa.array(compared[full]), lists], names=["cluster", "count", "compared", "sums"])

    return in_arrow(trees, moved, "cluster long, count long, compared long, sums array<long>")


def next_centroids(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floors of means; a centroid without vectors stays."""
    parts = round_sums(trees, centroids).select("cluster", "count", F.posexplode("sums").alias("pos", "x"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "pos").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("count").alias("n")).collect():  # k times the dimensions
        if r["n"]:
            out[r["cluster"], r["pos"]] = int(r["x"]) // r["n"]
    return out


def starting(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in the order of hashes."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in kept.where("vec_id is not null").select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64)


def assigned(trees: DataFrame, centroids: np.ndarray, key: str) -> DataFrame:
    """vec_id, cluster and distance (squared) of each vector."""

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for ids, tree in trees_in(batch, centroids.shape[1]):
                cluster, *_ = tree.assign(centroids)
                distance = ((tree.x - centroids[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return in_arrow(trees, placed, f"vec_id {key}, cluster int, distance long")


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, salt: str = "2:", vector: Column | str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector that takes part, and the final centroids."""
    v = F.col(vector) if isinstance(vector, str) else vector
    kept = vectors.where(finite(v) & (F.size(v) == dimensions)).select("vec_id", integers(v).alias("v"))
    centroids = starting(kept, k, salt)
    key = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return kept.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    trees = ball_trees(kept, dimensions)
    for _ in range(rounds):
        centroids = next_centroids(trees, centroids)
    return assigned(trees, centroids, key), centroids


def cluster_digest(vectors: DataFrame) -> DataFrame:
    """Each vector's cluster and squared distance, the sums of distances, and a checksum of its centroid."""
    found, centroids = centroid_clusters(vectors)
    found = stored(found, "clusters")
    sums = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    inertia = sums.agg(F.try_sum("cluster_inertia")).first()[0]
    texts = found.sparkSession.createDataFrame([(j, ",".join(map(str, c))) for j, c in enumerate(centroids.tolist())], "cluster int, shown string")
    whole = sums.join(texts, "cluster").select("cluster", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), F.sha2("shown", 256).alias("centroid_sha256"))  # a row a centroid
    return found.join(F.broadcast(whole), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
