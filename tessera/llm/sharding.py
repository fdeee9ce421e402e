"""Sharding: a two-pass external shuffle into shards of nearly equal counts, with Spark expressions only.

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash of the row and, of equal rows, of the copy's
number. For that equal rows are counted first (with a map-side combine), and given again one by one; a row of very many
copies is dealt out in portions of ``COPIES``. So neither the rows' order nor their partitioning has a part in the
result, and no key, source or group of copies fills a bucket. Pass two brings each bucket together, sorts it, and
shuffles it by Spark's seeded ``shuffle`` (a Fisher-Yates permutation). Buckets follow one another; row p of all N goes
to shard floor(p * shards / N), so that shards' counts differ by at most one (law ``rows``). Neighbouring buckets are one
partition, ``PART_BUCKETS`` each, so that a task writes to few shards.

Defined cases: null texts have size 16; null ids and repeated rows are rows like any other; with fewer rows than
shards some shards stay empty; an empty table gives an empty result; extra columns are carried (maps aren't, as
Spark doesn't compare them), and a clash with a column made here raises ValueError.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MADE = ("shard", "slot", "_n", "_copy", "_portion", "_bucket", "_part", "_at", "_row", "_rows", "_k")
COPIES = 1024  #: of a row that one task gives at a time
BUCKET_BYTES = 8 << 20  #: what a bucket holds on average; a bucket is the most that is brought together
PART_BUCKETS = 4  #: buckets of a task, on average
GROUP = 4096  #: buckets that are counted together


def row_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text (none if null), plus 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def copies(rows: DataFrame, tasks: int) -> DataFrame:
    """rows (_row, _n and others) once for each of their _n copies, with ``_copy`` (from 0)."""
    portions = F.ceil(F.col("_n") / COPIES)
    few = rows.where(F.col("_n") <= COPIES).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    many = rows.where(F.col("_n") > COPIES).withColumn("_portion", F.explode(F.sequence(F.lit(0).cast("long"), portions - 1))).repartition(tasks, "_row", "_portion")
    first = F.col("_portion") * COPIES
    return few.unionByName(many.withColumn("_copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("_n")) - 1))).drop("_portion"))


def shuffle_into_shards(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, text: str = "text") -> DataFrame:
    """docs with ``shard`` (0 to shards - 1) and ``slot`` (place in the shard, gapless from 0), in random order."""
    if clash := [c for c in docs.columns if c.lower() in MADE]:
        raise ValueError(f"columns of the input clash with those made here: {clash}")
    spark = docs.sparkSession
    n_bytes, total = docs.agg(F.coalesce(F.sum(row_bytes(text)), F.lit(0)), F.count("*")).first()
    buckets = max(1, math.ceil(n_bytes / bucket_bytes))
    parts = max(1, math.ceil(buckets / PART_BUCKETS))
    tasks = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    bucket = F.pmod(F.xxhash64(F.lit(seed), "_hash", "_copy"), F.lit(buckets)).cast("int")
    part = F.floor(F.col("_bucket") * parts / buckets).cast("int")
    # the buckets' counts need the rows' hashes alone
    hashes = docs.select(F.xxhash64(*columns).alias("_hash")).groupBy("_hash").agg(F.count("*").alias("_n")).withColumn("_row", F.col("_hash"))
    sizes = copies(hashes, tasks).select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("_n"))
    group = F.floor(F.col("_bucket") / GROUP).cast("int")
    groups = sorted(sizes.groupBy(group.alias("g")).agg(F.sum("_n").alias("n")).collect())  # one small row for GROUP buckets, that is for 32 GB
    before = spark.createDataFrame(list(zip([g["g"] for g in groups], accumulate([g["n"] for g in groups], initial=0))), "_g int, _before long")
    inside = F.array_sort(F.collect_list(F.struct("_bucket", "_n")))
    ordered = sizes.groupBy(group.alias("_g")).agg(inside.alias("_all")).join(F.broadcast(before), "_g")
    state = F.struct(F.col("_before").alias("at"), F.array().cast("array<struct<bucket:int,at:bigint>>").alias("out"))
    placed = F.aggregate("_all", state, lambda acc, b: F.struct((acc["at"] + b["_n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(b["_bucket"].alias("bucket"), acc["at"].alias("at")))).alias("out")), lambda acc: acc["out"])
    starts = ordered.select(F.explode(placed).alias("s")).select(F.col("s.bucket").alias("_bucket"), F.col("s.at").alias("_at"))

    counted = docs.groupBy(*columns).agg(F.count("*").alias("_n"))
    rows = counted.select(F.xxhash64(*columns).alias("_hash"), F.struct(*columns).alias("_row"), "_n")
    scattered = copies(rows, tasks).select(bucket.alias("_bucket"), F.struct(F.xxhash64("_row", "_copy").alias("k"), F.col("_row").alias("row")).alias("_row"))
    # a bucket's start comes with its rows, so that rows are brought together once
    kind = scattered.schema["_row"].dataType
    both = scattered.withColumn("_at", F.lit(None).cast("long")).unionByName(starts.withColumn("_row", F.lit(None).cast(kind)))
    full = both.withColumn("_part", part).repartitionById(parts, F.col("_part")).groupBy("_part", "_bucket").agg(F.array_sort(F.collect_list("_row")).alias("_rows"), F.max("_at").alias("_at"))
    # Spark's shuffle draws from a generator for each partition, so buckets have to lie in one partition and come in one order
    out = full.sortWithinPartitions("_bucket").select("_at", F.posexplode(F.shuffle("_rows", seed)).alias("_k", "_row")).select("_row.row", (F.col("_at") + F.col("_k")).alias("_at"))
    shard = F.expr(f"cast(cast(_at as decimal(38,0)) * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"cast((cast(shard as decimal(38,0)) * {total} + {shards - 1}) div {shards} as bigint)")
    return out.withColumn("shard", shard).select("row.*", "shard", (F.col("_at") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> DataFrame:
    """Write one folder per shard (``path/shard=K``), and read it back; a task writes the shards of its buckets.

    Files hold their rows in the order of their slots, and a shard's files together all its slots.
    """
    sharded.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path)


def shard_digest(sharded: DataFrame) -> DataFrame:
    """One row per row: its size, the checksum of the text that was placed, and its place."""
    return sharded.select(
        "doc_id",
        row_bytes().alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
