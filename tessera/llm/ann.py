"""Nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm (0 for queries), so that the largest
inner product is the smallest Euclidean distance. ``PROJECTIONS`` Gaussian (2-stable) projections, cut into
slabs of a width, make the buckets of a table; ``TABLES`` tables have their own. A query visits its own bucket
and perturbed ones in the order of their estimated success (the squared distances from the query's
projections to the buckets' slabs), until the visited ones hold a share of a table's distinct vectors, and more
than k of them (or all). Copies share a bucket and count once, so many copies don't use up a query's share. All visited
rows of all tables are candidates, and are ranked by their exact inner products in double precision.

The share is fitted: for ``TRIED`` queries (those with the smallest hashes) the true neighbours among all rows are found by
brute force, and the share is the smallest that reaches ``RECALL`` of them. So it follows the data and their
number; structured vectors need less. Buckets are dealt into parts of about ``PART`` rows (a larger bucket takes several); a
query comes to a part once, with the list of the buckets that it visits there, and takes at most k rows from it.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do
vectors of another length than most; rows without vec_id take no part; ids have to be integers (others raise ValueError); hashing scales
vectors by the largest component, so that no norm leaves the range of doubles; an inner product that does is infinite, as doubles have it,
and one that is no number (infinities of both signs) counts as the smallest; repeated rows are candidates each; fewer
candidates than k are all returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm.arrays import one_array
from tessera.llm.tables import in_arrow, stored

TABLES = 2
PROJECTIONS = 8
WIDTH = 2.5  #: of a slab, where the largest norm is 1 and projections have a deviation of 1
RECALL = 0.94  #: of the tried queries' neighbours
TRIED = 64  #: queries that the share of visited vectors is fitted on
PART = 8192
QUERIES_AT_ONCE = 256
COSTS_AT_ONCE = 1 << 21  #: costs of buckets that a worker holds


class Index:
    """Projections and slabs, from a seed, the dimension, the largest component and the largest norm in units of it."""

    def __init__(self, dimensions: int, scale: float, largest: float, tables: int = TABLES, projections: int = PROJECTIONS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.shape = (tables, projections)
        self.a = rng.normal(size=(dimensions + 1, tables * projections))
        self.b = rng.uniform(0, WIDTH, tables * projections)
        self.scale, self.largest = scale, largest

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Projections of rows of x, in units of slabs: (rows, tables, projections)."""
        unit = x / self.scale / self.largest
        if query:  # the direction alone decides which inner products are largest
            unit = x / np.abs(x).max(1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            rest = np.zeros(len(x))
        else:
            rest = np.sqrt(np.maximum(0, 1 - (unit**2).sum(1)))
        return ((np.column_stack([unit, rest]) @ self.a + self.b) / WIDTH).reshape(len(x), *self.shape)


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(one_array(column)).to_numpy(zero_copy_only=False), float).reshape(-1, dimensions)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the vectors that take part, of whatever length."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.select("vec_id", v.alias("v")).where("vec_id is not null and v is not null").where(finite).where(F.exists("v", lambda x: x != 0))


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """In doubles; what is no number counts as the smallest."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = q @ x.T
    return np.where(np.isnan(score), -np.inf, score)


def visiting_order(projected: np.ndarray, slab: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query (projections on a table) the buckets in the order of visits, and the distinct vectors before each."""
    cost = np.zeros((len(projected), len(slab)))
    for j in range(projected.shape[1]):
        low = slab[:, j][None] - projected[:, j][:, None]
        cost += np.maximum(0, np.maximum(low, -low - 1)) ** 2
    order = np.argsort(cost, axis=1, kind="stable")
    return order, np.cumsum(distinct[order], axis=1) - distinct[order]


def in_parts(buckets: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """For buckets (table, rows), in order: the first part of each, how many parts it has, and the number of parts.

    A part holds buckets of one table, so a row at most once.
    """
    first, n, part, held, last = [], [], 0, 0, None
    for table, size in buckets:
        if held and (table != last or held + size > PART):
            part, held = part + 1, 0
        own = max(1, math.ceil(size / PART))
        first.append(part)
        n.append(own)
        part, held = (part + own, 0) if own > 1 else (part, held + size)
        last = table
    return np.array(first), np.array(n), part + (held > 0)


def nearest(vectors: DataFrame, is_query, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row where ``is_query`` holds, among all other rows."""
    spark = vectors.sparkSession
    if not isinstance(vectors.schema["vec_id"].dataType, IntegralType):
        raise ValueError("vec_id has to be an integer")
    rows = usable(vectors)
    largest_part = F.array_max(F.transform("v", lambda x: F.abs(x)))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(largest_part).alias("m")).orderBy(F.desc("n"), "d").limit(1).collect()
    none = rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    if not lengths:
        return none
    dimensions, scale = lengths[0]["d"], lengths[0]["m"]
    rows = rows.where(F.size("v") == dimensions)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / scale) * (x / scale)))
    index = Index(dimensions, scale, rows.agg(F.max(norm)).first()[0])

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            slabs = np.floor(index.project(matrix(batch.column(1), dimensions), False)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(slabs) + 1) * PROJECTIONS, pa.int32()), pa.array(slabs[:, t].ravel())) for t in range(TABLES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=["vec_id", "v", *(f"slab_{t}" for t in range(TABLES))])

    slab_kinds = ", ".join(f"slab_{t} array<int>" for t in range(TABLES))
    filed = stored(in_arrow(rows, hashed, f"vec_id long, v array<double>, {slab_kinds}"), "hashed")
    buckets = None
    for t in range(TABLES):
        copies = filed.groupBy(F.col(f"slab_{t}").alias("slab"), F.xxhash64("v")).agg(F.count("*").alias("n"))
        one = copies.groupBy(F.lit(t).alias("table"), "slab").agg(F.sum("n").alias("n"), F.count("*").alias("distinct"))
        buckets = one if buckets is None else buckets.unionByName(one)
    # occupied buckets: about four slabs in each of PROJECTIONS directions, some thousands a table
    known = [(r["table"], tuple(r["slab"]), r["n"], r["distinct"]) for r in buckets.orderBy("table", "slab").collect()]
    number = {(t, slab): j for j, (t, slab, _, _) in enumerate(known)}
    first, n_parts, parts_in_all = in_parts([(t, n) for t, _, n, _ in known])
    tables = []
    for t in range(TABLES):
        own = [(slab, distinct, number[t, slab]) for table, slab, _, distinct in known if table == t]
        tables.append(tuple(np.array(x) for x in zip(*own)))

    tried = rows.where(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIED).collect()
    if not tried:
        return none
    asked_ids, asked_vectors = np.array([r["vec_id"] for r in tried]), np.array([r["v"] for r in tried])

    def true_neighbours(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's best k rows for each tried query."""
        best = pa.table({})
        for batch in (b for b in it if b.num_rows):
            own = asked_ids[:, None] == batch.column(0).to_numpy()[None]
            score = np.where(own, -np.inf, inner_products(asked_vectors, matrix(batch.column(1), dimensions)))
            n = min(k, score.shape[1])
            col = np.argpartition(-score, n - 1, axis=1)[:, :n].ravel()
            query = np.repeat(np.arange(len(asked_ids)), n)
            fine = ~own[query, col]
            own = batch.take(pa.array(col[fine]))
            some = pa.table([pa.array(query[fine]), pa.array(score[query, col][fine]), *own.columns[2:]], names=["query", "score", *(f"slab_{t}" for t in range(TABLES))])
            best = pa.concat_tables([best, some]) if len(best) else some
            query, score = best.column("query").to_numpy(), best.column("score").to_numpy()
            order = np.lexsort((-score, query))
            nth = np.arange(len(order)) - np.searchsorted(query[order], query[order])
            best = best.take(pa.array(order[nth < k]))
        yield from best.combine_chunks().to_batches()

    found = in_arrow(filed, true_neighbours, f"query long, score double, {slab_kinds}")
    top = Window.partitionBy("query").orderBy(F.desc("score"))
    pairs = found.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k).collect()  # TRIED * k rows
    needed = np.full(len(pairs), np.inf)
    projected = index.project(asked_vectors, True)
    for t, (slab, distinct, ident) in enumerate(tables):
        order, before = visiting_order(projected[:, t], slab, distinct)
        place = {tuple(x): j for j, x in enumerate(slab.tolist())}
        at = np.empty_like(order)
        np.put_along_axis(at, order, np.broadcast_to(np.arange(len(slab)), order.shape), 1)
        own = [before[r["query"], at[r["query"], place[tuple(r[f"slab_{t}"])]]] / distinct.sum() for r in pairs]
        needed = np.minimum(needed, own)
    share = float(np.quantile(needed, recall, method="higher")) + 1e-9 if len(pairs) else 1.0

    def probes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            projected = index.project(matrix(batch.column(1), dimensions), True)
            at_once = max(1, min(QUERIES_AT_ONCE, COSTS_AT_ONCE // max(len(slab) for slab, _, _ in tables)))
            for lo in range(0, len(projected), at_once):
                query, bucket = [], []
                for t, (slab, distinct, ident) in enumerate(tables):
                    order, before = visiting_order(projected[lo : lo + at_once, t], slab, distinct)
                    q, at = np.nonzero(before < max(share * distinct.sum(), k + 1))
                    query.append(q)
                    bucket.append(ident[order[q, at]])
                query, bucket = np.concatenate(query), np.concatenate(bucket)
                n = n_parts[bucket]
                part = np.repeat(first[bucket], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                query, bucket = np.repeat(query, n), np.repeat(bucket, n)
                order = np.lexsort((bucket, part, query))
                query, bucket, part = query[order], bucket[order], part[order]
                new = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (part[1:] != part[:-1])))
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(query)), pa.int32()), pa.array(bucket.astype(np.int32)))
                take = pa.array(query[new] + lo)
                yield pa.RecordBatch.from_arrays([pa.array(part[new]), batch.column(0).take(take), batch.column(1).take(take), lists], names=["part", "vec_id", "v", "buckets"])

    asked = in_arrow(rows.where(is_query), probes, "part long, vec_id long, v array<double>, buckets array<int>")
    names = spark.createDataFrame([(t, list(slab), j, int(first[j]), int(n_parts[j])) for j, (t, slab, _, _) in enumerate(known)], "table int, slab array<int>, bucket int, first long, parts int")
    placed = None
    for t in range(TABLES):
        here = names.where(F.col("table") == t).select("slab", "bucket", "first", "parts")  # a row for each bucket
        one = filed.select("vec_id", "v", F.col(f"slab_{t}").alias("slab")).join(F.broadcast(here), "slab")
        one = one.select((F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).alias("part"), "vec_id", "v", F.array("bucket").alias("buckets"))
        placed = one if placed is None else placed.unionByName(one)

    def ranked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part, first those of the index by bucket, then queries."""
        here, ids, held, filed_under, ready = None, [], [], [], None
        for batch in it:
            part, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
                if lo == hi:
                    continue
                some = batch.slice(lo, hi - lo)
                x, vec = some.column(2).to_numpy(), matrix(some.column(3), dimensions)
                if part[lo] != here:
                    here, ids, held, filed_under, ready = part[lo], [], [], [], None
                if not asks[lo]:
                    ids.append(x)
                    held.append(vec)
                    filed_under.append(some.column(4).flatten().to_numpy())
                elif ids:
                    if ready is None:
                        ready = np.concatenate(ids), np.concatenate(held), np.concatenate(filed_under)
                    for start in range(0, len(x), QUERIES_AT_ONCE):
                        own = some.column(4).slice(start, QUERIES_AT_ONCE)
                        sizes = own.value_lengths().to_numpy()
                        yield best_of(x[start : start + QUERIES_AT_ONCE], vec[start : start + QUERIES_AT_ONCE], np.repeat(np.arange(len(sizes)), sizes), own.flatten().to_numpy(), *ready)

    def best_of(query: np.ndarray, q: np.ndarray, who: np.ndarray, visited: np.ndarray, ids: np.ndarray, held: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
        """``who`` visits bucket ``visited``; rows of the index are ordered by bucket."""
        rough, seen = np.full((len(query), len(ids)), -np.inf), np.zeros((len(query), len(ids)), bool)
        order = np.argsort(visited, kind="stable")
        once, begin = np.unique(visited[order], return_index=True)
        lo, hi = np.searchsorted(bucket, once), np.searchsorted(bucket, once, "right")
        for a, b, own in zip(lo.tolist(), hi.tolist(), np.split(who[order], begin[1:])):
            rough[own, a:b], seen[own, a:b] = inner_products(q[own], held[a:b]), True
        same = query[:, None] == ids[None]
        rough[same], seen[same] = -np.inf, False
        n = min(k, len(ids))
        floor = -np.partition(-rough, n - 1, axis=1)[:, n - 1]
        slack = 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(floor), floor, 0)))
        row, col = np.nonzero((rough >= (floor - slack)[:, None]) & seen)
        with np.errstate(over="ignore", invalid="ignore"):
            score = (q[row] * held[col]).sum(1)  # the same for equal vectors, wherever they stand
        score = np.where(np.isnan(score), -np.inf, score)
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, np.arange(len(query)))[row]
        keep = nth < k
        return pa.RecordBatch.from_arrays([pa.array(query[row[keep]]), pa.array(ids[col[keep]]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts_in_all)
    both = placed.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True))).select("part", "asks", "vec_id", "v", "buckets")
    found = in_arrow(both.repartition(parts, "part").sortWithinPartitions("part", "asks", F.when(~F.col("asks"), F.get("buckets", F.lit(0)))), ranked, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
