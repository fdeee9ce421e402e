"""Mixing sources to target weights: Efraimidis-Spirakis sampling, with Spark expressions only.

A document's size is its number of words. Sources, in the order of their code points (null last), weigh ``weights``, repeating, and share
all words by weight; a target stops at ``most`` times its source's size, and what it leaves is shared by weight again,
until none is above. A source is taken whole as often as its target holds it (complete epochs); the rest of the target is
a sample of its documents: each has a key -ln(u) / w, with u from a seeded hash of id and text, and w its quality weight, and the
documents with the smallest keys are taken, up to the one whose middle passes the rest. So documents of weight 2w come
twice as soon, no document is taken over ceil(``most``) times, and reruns agree.

No source is sorted as a whole. Keys are cut into buckets of about ``BUCKET`` documents by a monotone function of the
key; sums of sizes by bucket (a row for each ``BUCKET`` documents) are summed up along a source, and only the
documents of the one bucket in which the rest runs out are sorted. That gives one cut for each source, so the documents
themselves pass by once, and aren't shuffled. Rows of one source, key and text are one group in this, whatever their number.
The cuts, one row a source, are broadcast up to ``FEW_SOURCES`` sources; beyond, documents are joined to them salted.

Defined cases: a null or blank text has size 0 and takes nothing; null sources are one source, the last, null ids are rows like any other;
of equal rows so many are taken as the cut says, whichever; a source without words has a target of 0; an empty table gives an
empty result; extra columns stay (maps only where no cut falls among equal rows, as Spark doesn't compare them), but columns named like
those made here are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.sharding import copies
from tessera.llm.tables import stored

MADE = ("size", "source_size", "target", "taken")
WORD = r"[^\x20\x09-\x0D]+"
BUCKET = 1 << 12  #: documents of a bucket, on average
FEW_SOURCES = 100_000  #: whose cuts, of some 100 bytes each, are broadcast
SALTS = 64
LEAST_WEIGHT = 0.1


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """From 0.1 to 1: the share of letters among characters that aren't blank, times the share of lines that are new."""
    shown = F.regexp_replace(text, r"\s+", "")
    letters = F.length(F.regexp_replace(shown, r"\P{L}+", "")) / F.greatest(F.length(shown), F.lit(1))
    lines = F.split(text, "\n", -1)
    return F.coalesce(LEAST_WEIGHT + (1 - LEAST_WEIGHT) * letters * F.size(F.array_distinct(lines)) / F.size(lines), F.lit(LEAST_WEIGHT))


def source_sizes(slim: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """_null, _source, source_size, rows, mean (of the quality weights) and weight of each source.

    Sources are numbered by ranges, each range by itself, and the ranges' counts are summed up.
    """
    spark = slim.sparkSession
    sums = slim.groupBy("_null", "_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"), F.avg("weight").alias("mean"))
    placed = stored(sums.repartitionByRange("_null", "_source").withColumn("part", F.spark_partition_id()), "sources")
    counts = sorted(placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, at = [], 0
    for part, n in counts:
        before.append((part, at))
        at += n
    number = F.row_number().over(Window.partitionBy("part").orderBy("_null", "_source")) - 1 + F.col("before")
    place = (number % len(weights) + 1).cast("int")
    ranked = placed.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part")
    return ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place)).drop("part", "before")


def with_targets(sources: DataFrame, most: float) -> DataFrame:
    """sources with ``target``: what a source gets by weight, or ``most`` times its size where that is less."""
    ceiling = F.col("source_size") * F.lit(float(most))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = 0.0, -1
    while True:  # the level only rises, and with it the sources that are full
        stops = ceiling <= F.col("weight") * F.lit(level)
        got = sources.agg(F.count_if(stops).alias("n"), F.sum(F.when(stops, ceiling)).alias("taken"), F.sum(F.when(~stops, F.col("weight"))).alias("open")).first()
        if got["n"] == full or not got["open"]:
            break
        full, level = got["n"], (total - (got["taken"] or 0.0)) / got["open"]
    return sources.withColumn("target", F.least(ceiling, F.col("weight") * F.lit(level)) if got["open"] else ceiling)


def by_source(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """rows with the columns of their source's plan (_null, _source and others)."""
    if n_sources <= FEW_SOURCES:
        return rows.join(F.broadcast(plan), ["_null", "_source"])
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod("_tie", F.lit(SALTS))).join(salted, ["_null", "_source", "_salt"]).drop("_salt")


def bucket() -> Column:
    """A bucket of the key in its source, from 0; keys of weights like the mean are uniform over them."""
    n = F.ceil(F.col("rows") / BUCKET)
    return F.least(F.floor(n * (1 - F.exp(-F.col("_key") * F.col("mean")))), n - 1)


def cuts(slim: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """For each source: ``last`` (bucket in which the rest runs out), ``cut`` (key and tie of the last group that is taken there), ``m`` (its copies that are taken) and ``n`` (all of them)."""
    keyed = by_source(slim, plan, n_sources).where("rest > 0").withColumn("b", bucket())
    along = Window.partitionBy("_null", "_source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = keyed.groupBy("_null", "_source", "b").agg(F.sum("size").alias("held")).withColumn("upto", F.sum("held").over(along))
    rest = plan.select("_null", "_source", "rest")
    last = sums.join(rest, ["_null", "_source"]).where("upto > rest").groupBy("_null", "_source").agg(F.min(F.struct("b", (F.col("upto") - F.col("held")).alias("before"))).alias("at"))
    last = stored(last.select("_null", "_source", F.col("at.b").alias("last"), F.col("at.before").alias("before")), "last-buckets")
    there = by_source(keyed, last, n_sources).where("b = last and size > 0")
    groups = there.groupBy("_null", "_source", "last", "before", "rest", "_key", "_tie", "size").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("_null", "_source").orderBy("_key", "_tie", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("before") + F.sum(F.col("n") * F.col("size")).over(ordered) - F.col("n") * F.col("size")
    m = F.least(F.greatest(F.floor((F.col("rest") - F.col("start")) / F.col("size") + 0.5), F.lit(0)), F.col("n"))
    taken = groups.withColumn("start", start).withColumn("m", m).where("m > 0")
    found = taken.groupBy("_null", "_source").agg(F.max(F.struct("_key", "_tie", "m", "n")).alias("g"))
    found = found.select("_null", "_source", F.struct("g._key", "g._tie").alias("cut"), F.col("g.m").alias("m"), F.col("g.n").alias("n"))
    return stored(last.drop("before").join(found, ["_null", "_source"], "left"), "cuts")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, seed: int = 23, text: str = "text", source: str = "source", key: str = "doc_id", quality: Column | None = None) -> DataFrame:
    """docs with ``size`` (words), ``source_size``, ``target`` (of the source) and ``taken`` (words that the mix takes of the row, repeats counted).

    ``quality``: a document's weight in its source, a positive column; by default ``quality_weight``.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in MADE])
    name = F.col(source)
    tie = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text)), 12) + 0.5) / float(1 << 52)
    weight = quality_weight(text) if quality is None else quality
    sized = docs.select(kept.alias("_doc"), word_count(text).alias("size"), name.isNull().alias("_null"), F.coalesce(name.cast("string"), F.lit("")).alias("_source"), (-F.log(unit) / weight).alias("_key"), tie.alias("_tie"), weight.alias("_weight"))
    slim = stored(sized.select("_null", "_source", "size", "_key", "_tie", F.col("_weight").alias("weight")), "mix-keys")
    plan = stored(with_targets(source_sizes(slim, weights), most), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.select("_null", "_source", "source_size", "rows", "mean", "target", epochs.alias("epochs")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    n_sources = plan.count()
    whole = stored(plan.join(cuts(slim, plan, n_sources), ["_null", "_source"], "left"), "mix-plan")
    placed = by_source(sized, whole, n_sources)
    here = F.struct("_key", "_tie")
    in_part = F.coalesce((F.col("b") == F.col("last")) & (here == F.col("cut")), F.lit(False)) & (F.col("m") < F.col("n"))
    more = F.coalesce((F.col("b") < F.col("last")) | ((F.col("b") == F.col("last")) & (here <= F.col("cut"))), F.lit(False))
    placed = placed.withColumn("b", bucket())

    def result(rows: DataFrame, again: Column) -> DataFrame:
        return rows.select("_doc.*", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + again.cast("long"))).alias("taken"))

    out = result(placed.where(~in_part), more)
    if whole.where("m < n").limit(1).count():  # equal rows of which some are taken
        shared = [F.col(c) for c in ("_doc", "size", "source_size", "target", "epochs", "m")]
        groups = placed.where(in_part).groupBy(*shared).agg(F.count("*").alias("_n")).withColumn("_row", F.xxhash64(*shared))
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = out.unionByName(result(copies(groups, tasks), F.col("_copy") < F.col("m")))
    return out


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    rows = mix_sources(docs, **options)
    return rows.where("taken > 0").withColumn("taken", F.explode(F.sequence(F.lit(1).cast("long"), (F.col("taken") / F.col("size")).cast("long")))).drop(*MADE)


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: its size, its source's size and target, and the words that the mix takes."""
    return mix_sources(docs.select("doc_id", "text", "source")).select("doc_id", *MADE)
