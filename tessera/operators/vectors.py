"""Vector operators: similarity, normalisation, means, best match against a roster, and base64 vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
ROSTER_BLOCK = 256
QUERY_BLOCK, ROWS_A_PART = 8192, 4096  #: queries that a task holds, rows that it holds them against
SCORES_AT_ONCE = 1 << 20


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null for different lengths."""
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """Length 1; a zero vector stays."""
    size = norm(v)
    return F.when(size > 0, F.transform(v.cast("array<double>"), lambda x: x / size)).otherwise(v.cast("array<double>"))


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """key, n, centroid: the normalised mean of each key's vectors; partial sums by component go over the shuffle."""
    parts = vectors.where("embedding is not null").select(key, F.posexplode("embedding").alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    whole = parts.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"))
    return whole.select(key, "n", normalized(F.col("mean")).alias("centroid"))


def met_with_blocks(rows: DataFrame, entries: DataFrame, key: str, entry: Column, n_bytes: int, n: int, salts: int) -> DataFrame:
    """rows (with an id in ``key``) beside every block of entries, as the array ``entries``.

    Blocks are broadcast only if they are known to take no more than ``BROADCAST_BYTES``; else rows meet them by a salted
    join. So a row meets blocks, not entries, and none of them is a cross join.
    """
    blocks = max(1, -(-n // ROSTER_BLOCK))
    held = entries.select(F.pmod(F.xxhash64(entry), F.lit(blocks)).alias("block"), entry.alias("entry")).groupBy("block").agg(F.collect_list("entry").alias("entries"))
    asked = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    if n_bytes <= BROADCAST_BYTES:
        return asked.join(F.broadcast(held), "block")
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return asked.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).join(held.withColumn("salt", salt), ["block", "salt"])


def best_match(vectors: DataFrame, roster: DataFrame, threshold: float, salts: int = 64) -> DataFrame:
    """vec_id, person_id, score: the best roster entry (person_id, centroid) of each vector, from ``threshold`` on.

    Of equal scores the greater person_id wins; entries of another length don't count.
    """
    n, wide = roster.agg(F.count("*"), F.coalesce(F.max(F.size("centroid")), F.lit(0))).first()
    entry = F.struct("person_id", F.col("centroid").cast("array<double>").alias("centroid"))
    asked = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    met = met_with_blocks(asked, roster, "vec_id", entry, n * wide * 8, n, salts)
    scored = F.array_max(F.transform("entries", lambda e: F.struct(dot(F.col("v"), e["centroid"]).alias("score"), e["person_id"].alias("person_id"))))
    best = met.select("vec_id", scored.alias("m")).groupBy("vec_id").agg(F.max("m").alias("m"))
    return best.where(F.col("m.score") >= threshold).select("vec_id", "m.person_id", "m.score")


def matches_over(vectors: DataFrame, is_query: Column, threshold: float, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, score: for a stated set of queries, all other rows of at least this similarity.

    Queries are dealt into blocks and rows into parts, and each part meets each block in a task, which holds the block and streams the rows.
    Matrix products find what may reach the threshold; its score is then summed in order, as ``dot`` does. As there, vectors with nulls or of
    different lengths don't match, and a score that isn't a number counts as over every threshold.
    """
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    n, n_queries = rows.agg(F.count("*"), F.count_if("asks")).first()
    parts, blocks = (max(1, -(-a // b)) for a, b in ((n, ROWS_A_PART), (n_queries, block)))

    def all_of(k: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    def one_of(k: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "v"), F.lit(k)).cast("int")

    queries = rows.where("asks").select(all_of(parts).alias("part"), one_of(blocks).alias("block"), "asks", "vec_id", "v")
    met = queries.unionByName(rows.select(one_of(parts).alias("part"), all_of(blocks).alias("block"), F.lit(False).alias("asks"), "vec_id", "v"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * parts * blocks)
    met = met.repartition(tasks, "part", "block").sortWithinPartitions("part", "block", F.desc("asks"))

    def compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part and block, first its queries."""
        here, held, ready = None, [], {}
        for batch in it:
            part, own, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "block", "asks"))
            edges = np.flatnonzero((part[1:] != part[:-1]) | (own[1:] != own[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(part)]):
                if lo == hi:
                    continue
                if (part[lo], own[lo]) != here:
                    here, held, ready = (part[lo], own[lo]), [], {}
                some = pa.Table.from_batches([batch.slice(lo, hi - lo)]).select(["vec_id", "v"])
                if asks[lo]:
                    held.append(some)
                    continue
                if held:
                    ready, held = by_length(pa.concat_tables(held)), []
                for wide, (ids, x) in by_length(some).items() if ready else ():
                    if wide in ready:
                        yield from scored(ids, x, *ready[wide])

    def by_length(table: pa.Table) -> dict[int, tuple[pa.Array, np.ndarray]]:
        """Ids and vectors of each length."""
        wide = pc.list_value_length(table.column("v"))
        found = {}
        for k in pc.unique(wide).to_pylist():
            own = table.filter(pc.equal(wide, k)).combine_chunks()
            flat = pc.list_flatten(own.column("v")).to_numpy()
            found[k] = own.column("vec_id").combine_chunks(), flat.reshape(len(own), k)
        return found

    def scored(ids: pa.Array, x: np.ndarray, asking: pa.Array, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            longest, step = np.linalg.norm(q, axis=1).max(), max(1, SCORES_AT_ONCE // len(q))
            for lo in range(0, len(x), step):
                some = x[lo : lo + step]
                bound = threshold - 1e-9 * (1 + np.linalg.norm(some, axis=1) * longest)
                row, at = np.nonzero(~(some @ q.T < bound[:, None]))  # also what isn't a number
                score = np.zeros(len(row))
                for k in range(x.shape[1]):
                    score += some[row, k] * q[at, k]
                fine = pa.array(~(score < threshold))
                a, b = asking.take(pa.array(at)), ids.take(pa.array(lo + row))
                yield pa.RecordBatch.from_arrays([a, b, pa.array(score)], names=["query_id", "vec_id", "score"]).filter(pc.and_(fine, pc.not_equal(a, b)))

    return met.mapInArrow(compared, f"query_id {kind}, vec_id {kind}, score double")


def encode_base64(vectors: DataFrame) -> DataFrame:
    """vec_id and ``wire``: the vector as little-endian 32-bit floats in base64."""
    @F.pandas_udf("binary")
    def raw(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return vectors.select("vec_id", F.base64(raw("embedding")).alias("wire"))


def decode_base64(wires: DataFrame) -> DataFrame:
    """vec_id and ``embedding``; null where the text isn't base64 of whole 32-bit floats."""
    @F.pandas_udf("array<float>")
    def floats(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))

    return wires.select("vec_id", floats(F.try_to_binary("wire", F.lit("base64"))).alias("embedding"))


def top_by(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key with their ``rank`` (from 1)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)
