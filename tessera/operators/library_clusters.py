"""Online clusters of a whole library, in one order, equal to the fold over one face after another.

Faces go in blocks of that order. In a block, all scores with the roster come from one pass over it: each face gets its best
``LISTED`` clusters of at least the threshold, as they stand when the block begins. Then one task settles the block in
order. A centroid only changes if a face of the block joins it, so the scores of all others hold; those that have changed in the block, and
those founded in it, are held as vectors and scored anew for each face. Where a face's list is full and all of its clusters have
changed, an unlisted one might be the best: unless a changed one is better than any unlisted can be, the block ends there, and the
rest of it begins the next. So nothing is assumed about how far centroids move, and a task holds one block's faces,
their lists and the centroids in these.

The roster is a versioned table: a block replaces the clusters that it has changed, and its faces' assignments are written beside it under
the block's number, so that a run that stopped goes on where its roster stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranges import ranked
from tessera.operators.upsert import upserted
from tessera.sources.places import written
from tessera.streaming.versioned import VersionedTable

BLOCK, LISTED = 8192, 8
ROSTER = "cluster long, size long, centroid array<float>"
FOUND = "rank long, vec_id long, cluster long, size long, score double, centroid array<float>"


def listed(block: DataFrame, roster: DataFrame, threshold: float, n: int) -> DataFrame:
    """rank and ``best``: for each face of a block that has any, its n best clusters of at least the threshold, best first, of equals the newest."""
    faces = [(r["rank"], np.asarray(r["embedding"], np.float32).astype(float)) for r in block.select("rank", "embedding").collect()]  # one block
    by_length = {d: ([k for k, v in faces if len(v) == d], np.array([v for _, v in faces if len(v) == d])) for d in {len(v) for _, v in faces}}

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            wide = pc.list_value_length(batch.column("centroid")).to_numpy()
            for d in np.unique(wide).tolist():
                if d not in by_length:
                    continue
                ranks, x = by_length[d]
                some = batch.filter(pa.array(wide == d))
                number = some.column("cluster").to_numpy()
                score = x @ pc.list_flatten(some.column("centroid")).to_numpy().astype(float).reshape(len(some), d).T
                row, at = np.nonzero(score >= threshold)
                order = np.lexsort((-number[at], -score[row, at], row))
                row, at = row[order], at[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                row, at = row[nth < n], at[nth < n]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ranks, np.int64)[row]), pa.array(number[at]), pa.array(score[row, at])], names=["rank", "cluster", "score"])

    pairs = roster.select("cluster", "centroid").mapInArrow(scored, "rank long, cluster long, score double")
    best = Window.partitionBy("rank").orderBy(F.desc("score"), F.desc("cluster"))
    top = pairs.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= n)
    return top.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("nth", "cluster", "score"))).alias("best"))


def settled(frame: pd.DataFrame, known: pd.DataFrame, threshold: float, n: int, first_new: int) -> pd.DataFrame:
    """Rows of ``FOUND`` for a block's faces (rank, vec_id, embedding, best), as far as it can be settled, with each cluster's last centroid on its last row."""
    start = {int(c): (int(s), np.asarray(v, np.float32)) for c, s, v in zip(known["cluster"], known["size"], known["centroid"])}
    changed: dict[int, int] = {}  # cluster: its row in held, by length
    held: dict[int, np.ndarray] = {}
    numbers: dict[int, list[int]] = {}
    sizes: dict[int, int] = {}
    out, last, new = [], {}, first_new

    def hold(cluster: int, v: np.ndarray) -> None:
        own, block = numbers.setdefault(len(v), []), held.setdefault(len(v), np.zeros((64, len(v)), np.float32))
        if len(own) == len(block):
            held[len(v)] = block = np.concatenate([block, np.zeros_like(block)])
        block[len(own)] = v
        changed[cluster] = len(own)
        own.append(cluster)

    for face in frame.sort_values("rank").itertuples(index=False):
        v = np.asarray(face.embedding, np.float32)
        best: tuple[float, int] | None = None  # (score, cluster): ties go to the newest
        own = numbers.get(len(v), [])
        if own:
            scores = held[len(v)][: len(own)].astype(float) @ v.astype(float)
            top = scores.max()
            if top >= threshold:
                best = (float(top), max(own[k] for k in np.flatnonzero(scores == top)))
        given = [] if face.best is None else [(float(b["score"]), int(b["cluster"])) for b in face.best]
        still = next((b for b in given if b[1] not in changed), None)
        if still is not None:
            best = still if best is None else max(best, still)
        elif len(given) == n and (best is None or best <= given[-1]):
            break  # an unlisted cluster may be the best
        if best is None:
            cluster, size, centroid, score = new, 1, v, None
            new += 1
            hold(cluster, v)
        else:
            score, cluster = best
            if cluster not in changed:
                sizes[cluster] = start[cluster][0]
                hold(cluster, start[cluster][1])
            size = sizes[cluster]
            centroid = held[len(v)][changed[cluster]]
            mean = ((centroid.astype(np.float64) * size + v) / (size + 1)).astype(np.float32)
            length = float(np.sqrt((mean.astype(np.float64) ** 2).sum()))
            held[len(v)][changed[cluster]] = mean.astype(np.float64) / length if length else mean
            size, centroid = size + 1, held[len(v)][changed[cluster]]
        sizes[cluster] = size
        last[cluster] = len(out), len(v)
        out.append([face.rank, face.vec_id, cluster, size, score, None])
    for cluster, (row, d) in last.items():
        out[row][5] = held[d][changed[cluster]].tolist()
    return pd.DataFrame(out, columns=["rank", "vec_id", "cluster", "size", "score", "centroid"])


def settling(threshold: float, n: int, first_new: int):
    def settle(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return settled(frame, known, threshold, n, first_new)

    return settle


def library_clusters(faces: DataFrame, place: str, threshold: float = 0.45, block: int = BLOCK, n: int = LISTED) -> tuple[DataFrame, VersionedTable]:
    """vec_id, cluster, size and score at assignment (null for a founder) of all faces, in the order of record_id, face_index and vec_id; and the roster.

    The rules are those of ``online_clusters``, with the library as one scope. Faces without an id or a vector take no part; ids are distinct.
    """
    spark = faces.sparkSession
    order = F.struct("record_id", "face_index", "vec_id")
    rows = faces.where("embedding is not null and vec_id is not null").select(order.alias("key"), "record_id", "vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    keyed = rows.withColumn("sorted", F.concat_ws("\x00", "record_id", F.lpad(F.col("key.face_index").cast("string"), 10, "0"), F.lpad(F.col("vec_id").cast("string"), 20, "0")))
    placed = written(ranked(keyed, "sorted").select("rank", "vec_id", "embedding").repartitionByRange("rank").sortWithinPartitions("rank"), "in-order")
    total = placed.count()
    roster = VersionedTable(spark, f"{place}/roster")
    if roster.version() is None:
        roster.create(spark.createDataFrame([], ROSTER), "cluster", max(1, total // (1 << 18)), {"done": "0", "clusters": "0", "block": "0"})
    marks = roster.version().marks
    done, clusters, number = int(marks["done"]), int(marks["clusters"]), int(marks["block"])
    while done < total:
        own = placed.where((F.col("rank") >= done) & (F.col("rank") < done + block))
        lists = written(listed(own, roster.read(), threshold, n), "lists")
        wanted = lists.select(F.explode("best").alias("b")).select("b.cluster").distinct()
        known = roster.read().join(wanted, "cluster", "left_semi")
        one = F.lit(0).alias("one")
        block_rows = own.join(lists, "rank", "left").select(one, "rank", "vec_id", "embedding", "best")
        found = block_rows.groupBy("one").cogroup(known.select(one, "*").groupBy("one")).applyInPandas(settling(threshold, n, clusters), FOUND)
        found.write.mode("overwrite").parquet(f"{place}/found/block={number}")
        got = spark.read.schema(FOUND).parquet(f"{place}/found/block={number}")
        n_done, most = got.agg(F.count("*"), F.max("cluster")).first()
        done, clusters, number = done + n_done, max(clusters, most + 1), number + 1
        roster.rewrite(got.where("centroid is not null").select("cluster", "size", "centroid"), lambda old, new: upserted(old, new, "cluster"), {"done": str(done), "clusters": str(clusters), "block": str(number)})
        roster.vacuum()
    if not total:
        return spark.createDataFrame([], "vec_id long, cluster long, size long, score double"), roster
    return spark.read.schema(FOUND + ", block int").parquet(f"{place}/found").where(F.col("block") < number).select("vec_id", "cluster", "size", "score"), roster
