"""All pairs of a table whose vectors are at least so similar, exactly, without comparing all pairs.

Equal vectors are one, named by their smallest id. Each vector belongs to the cell of its nearest pivot (some vectors
themselves, those of the smallest hashes). Of a cell are known its widest angle from the pivot and its longest vector; by
the triangle inequality of angles, a vector can only match a cell if its own angle to that pivot isn't too wide for it.
So each vector meets only such cells, and in a cell only the members whose angle to the pivot differs from its own by little enough.
What remains is scored in double precision and held against the threshold.

Cells of near pivots form groups of at most ``PART`` vectors; larger cells are dealt out in parts of that size, so none is brought
together as a whole. A vector is sent once to a group (or to each part) with any cell that it may match, each pair of groups from one
side; so copies of a vector grow with the groups and not with the cells. Where vectors have no structure, all pairs are scored: work
is quadratic then, but a task holds one group and a few visitors.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do rows without an
id; vectors of different lengths don't match; an empty table has no pairs. The threshold has to be over 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.places import written

PIVOTS = 512  #: at most, of each length; they are held by every task
PART = 16384
GROUPS = 32  #: at least, for many tasks
AT_ONCE, VISITORS = 256, 1024  #: of one cell, of one group
ANGLES_AT_ONCE = 1 << 20
PAIRS_AT_ONCE = 1 << 20
SENT_BYTES = 4 << 20
SLACK = 1e-6  #: of an angle; cosines are rounded at 1e-16, their angles at 1e-8


def classes(vectors: DataFrame) -> DataFrame:
    """rep_id, v and vec_ids: one row for equal vectors, with the ids of all of them."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(v, lambda x: x != 0)
    plain = F.transform(v, lambda x: x + F.lit(0.0))  # -0 as 0
    return vectors.where("vec_id is not null and embedding is not null").where(fine).groupBy(plain.alias("v")).agg(F.min("vec_id").alias("rep_id"), F.sort_array(F.collect_list("vec_id")).alias("vec_ids"))


def matrix(column: pa.Array, wide: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), wide)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def slices(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(batch), n):
        yield batch.slice(k, n)


def chain(centre: np.ndarray) -> np.ndarray:
    """The pivots' numbers, each followed by the nearest of those left."""
    near = centre @ centre.T
    order = [0]
    near[:, 0] = -np.inf
    for _ in range(len(centre) - 1):
        order.append(int(near[order[-1]].argmax()))
        near[:, order[-1]] = -np.inf
    return np.array(order)


def grouped(size: np.ndarray, part: int) -> np.ndarray:
    """The group of each cell, from 0: neighbours of at most ``part`` vectors together, or one larger cell."""
    group, held = np.zeros(len(size), np.int64), 0
    for k, n in enumerate(size.tolist()):
        group[k] = group[k - 1] + (held + n > part) if k else 0
        held = held + n if k and group[k] == group[k - 1] else n
    return group


def turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Do vectors of group a go to group b? Of two groups one goes to the other, and each to about half of all."""
    return (a == b) | ((a < b) == ((a + b) % 2 == 1))


def similar_pairs(vectors: DataFrame, threshold: float, pivots: int = PIVOTS, part: int = PART) -> tuple[DataFrame, int]:
    """(a, b, score) with a < b: all pairs of different vectors, by their smallest ids, with an inner product of at least ``threshold``; and how many pairs were scored."""
    if threshold <= 0:
        raise ValueError("the threshold has to be over 0")
    spark = vectors.sparkSession
    rows = written(classes(vectors).select("rep_id", "v", F.size("v").alias("wide")), "classes")
    out, scored = None, 0
    for wide, n in sorted((r["wide"], r["count"]) for r in rows.groupBy("wide").count().collect()):  # one row for each length of vectors
        found, count = pairs_of_length(rows.where(F.col("wide") == wide), wide, threshold, min(pivots, math.isqrt(n) * 4 + 1), part)
        out, scored = found if out is None else out.unionByName(found), scored + count
    return (spark.createDataFrame([], "a long, b long, score double") if out is None else out), scored


def pairs_of_length(rows: DataFrame, wide: int, threshold: float, n_pivots: int, part: int) -> tuple[DataFrame, int]:
    spark = rows.sparkSession
    chosen = np.array([r["v"] for r in rows.orderBy(F.xxhash64("rep_id"), "rep_id").limit(n_pivots).collect()])
    centre = chosen / np.linalg.norm(chosen, axis=1, keepdims=True)

    at_once = max(1, ANGLES_AT_ONCE // len(centre))

    def celled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in it for some in slices(whole, at_once)):
            x = matrix(batch.column("v"), wide)
            length = np.linalg.norm(x, axis=1)
            angle = angles(x / length[:, None], centre)
            cell = angle.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("rep_id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(x)), cell]), pa.array(length)], names=["rep_id", "v", "cell", "angle", "length"])

    placed = written(rows.select("rep_id", "v").mapInArrow(celled, "rep_id long, v array<double>, cell int, angle double, length double"), "cells")
    known = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("angle").alias("angle"), F.max("length").alias("length"), F.count("*").alias("n")).collect()}  # a row for each pivot
    cells = np.array([c for c in chain(centre).tolist() if c in known])
    rank = np.zeros(len(centre), np.int64)
    rank[cells] = np.arange(len(cells))
    widest, longest, size = (np.array([known[c][k] for c in cells.tolist()]) for k in ("angle", "length", "n"))
    part = min(part, max(1, -(-int(size.sum()) // GROUPS)))
    group = grouped(size, part)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    deals = np.maximum(1, -(-np.add.reduceat(size, starts) // part))

    def within(length: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The widest angle at which vectors of these lengths may reach the threshold; under 0 where none does."""
        share = threshold / (length * other)
        return np.where(share <= 1 + 1e-12, np.arccos(np.minimum(share, 1)) + SLACK, -1.0)

    def visits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once as a member of its group, and as a visitor of those that it may match and has to go to."""
        step = max(1, SENT_BYTES // (wide * 8))
        for batch in (some for whole in it for some in slices(whole, at_once)):
            x, cell, length, ids = matrix(batch.column("v"), wide), rank[batch.column("cell").to_numpy()], batch.column("length").to_numpy(), batch.column("rep_id").to_numpy()
            own = group[cell]
            may = angles(x / length[:, None], centre[cells]) - widest[None] <= within(length[:, None], longest[None])
            row, there = np.nonzero(np.logical_or.reduceat(may, starts, axis=1) & turn(own[:, None], np.arange(len(starts))[None]))
            n = deals[there]
            row, there, deal = np.repeat(row, n), np.repeat(there, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            mine = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % deals[own]
            take, to, deal = np.append(np.arange(len(x)), row), np.append(own, there), np.append(mine, deal)
            asks = np.arange(len(take)) >= len(x)
            for k in range(0, len(take), step):
                t = pa.array(take[k : k + step])
                here = to[k : k + step]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(here.astype(np.int32)), pa.array(deal[k : k + step].astype(np.int32)), pa.array(asks[k : k + step]), pa.array(cell.astype(np.int32)).take(t), batch.column("angle").take(t), pa.array(own[take[k : k + step]] == here), batch.column("rep_id").take(t), batch.column("v").take(t)],
                    names=["group", "deal", "asks", "cell", "angle", "home", "rep_id", "v"],
                )

    def compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group and part, first its members by cell and angle, then the visitors."""
        here, held, ready = None, [], None
        for batch in it:
            to, deal, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "deal", "asks"))
            edges = np.flatnonzero((to[1:] != to[:-1]) | (deal[1:] != deal[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(to)]):
                if lo == hi:
                    continue
                some = batch.slice(lo, hi - lo)
                if (to[lo], deal[lo]) != here:
                    here, held, ready = (to[lo], deal[lo]), [], None
                if not asks[lo]:
                    held.append((some.column("cell").to_numpy(), some.column("angle").to_numpy(), some.column("rep_id").to_numpy(), matrix(some.column("v"), wide)))
                    continue
                if held and ready is None:
                    ready, held = members(*(np.concatenate(x) for x in zip(*held))), []
                for few in slices(some, VISITORS) if ready else ():
                    yield from matched(few.column("rep_id").to_numpy(), matrix(few.column("v"), wide), few.column("home").to_numpy(zero_copy_only=False), *ready)

    def members(cell: np.ndarray, angle: np.ndarray, ids: np.ndarray, y: np.ndarray) -> tuple:
        """Cells of a part, where each begins, its widest angle and longest vector here; and the members."""
        at = np.flatnonzero(np.diff(cell, prepend=-1))
        return centre[cells[cell[at]]], np.append(at, len(cell)), np.maximum.reduceat(angle, at), np.maximum.reduceat(np.linalg.norm(y, axis=1), at), angle, ids, y

    def matched(ids: np.ndarray, x: np.ndarray, home: np.ndarray, pivot: np.ndarray, edges: np.ndarray, wide_to: np.ndarray, long_to: np.ndarray, their_angle: np.ndarray, theirs: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        length = np.linalg.norm(x, axis=1)
        angle = angles(x / length[:, None], pivot)
        reach = within(length[:, None], long_to[None])
        may = (reach >= 0) & (angle - wide_to[None] <= reach)
        low, high, scores, scored, n = [], [], [], 0, 0
        for c in np.flatnonzero(may.any(0)).tolist():
            there = slice(edges[c], edges[c + 1])
            order = np.flatnonzero(may[:, c])
            order = order[np.argsort(angle[order, c], kind="stable")]
            for k in range(0, len(order), AT_ONCE):
                few = order[k : k + AT_ONCE]
                lo = edges[c] + np.searchsorted(their_angle[there], (angle[few, c] - reach[few, c]).min())
                hi = edges[c] + np.searchsorted(their_angle[there], (angle[few, c] + reach[few, c]).max(), "right")
                rough = x[few] @ y[lo:hi].T
                p, q = np.nonzero(rough >= threshold - 1e-9 * np.maximum(1, np.abs(threshold)))
                p, q = few[p], lo + q
                score = (x[p] * y[q]).sum(1)
                fine = (score >= threshold) & (~home[p] | (ids[p] < theirs[q]))  # at home each pair meets twice, elsewhere once
                a, b = ids[p[fine]], theirs[q[fine]]
                low.append(np.minimum(a, b))
                high.append(np.maximum(a, b))
                scores.append(score[fine])
                scored, n = scored + rough.size, n + len(a)
                if n >= PAIRS_AT_ONCE:
                    yield together(low, high, scores, scored)
                    low, high, scores, scored, n = [], [], [], 0, 0
        if scored:
            yield together(low, high, scores, scored)

    def together(low: list, high: list, scores: list, scored: int) -> pa.RecordBatch:
        """Pairs, and a row without one for how many were scored."""
        n = sum(map(len, low))
        last = np.arange(n + 1) == n
        columns = [pa.array(np.append(np.concatenate(low), 0), mask=last), pa.array(np.append(np.concatenate(high), 0)), pa.array(np.append(np.concatenate(scores), 0.0)), pa.array(np.where(last, scored, 0))]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "score", "scored"])

    at = placed.mapInArrow(visits, "group int, deal int, asks boolean, cell int, angle double, home boolean, rep_id long, v array<double>")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * int(deals.sum()))
    met = at.repartition(tasks, "group", "deal").sortWithinPartitions("group", "deal", "asks", "cell", "angle")
    found = written(met.mapInArrow(compared, "a long, b long, score double, scored long"), "pairs")
    return found.where("a is not null").select("a", "b", "score"), found.agg(F.coalesce(F.sum("scored"), F.lit(0))).first()[0]
