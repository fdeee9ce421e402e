"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.minhash_dedup import drop_near_duplicates
from tessera.llm.packing import pack
from tessera.llm.quality_classifier import keep_predicted_good
from tessera.llm.quality_rules import reject_low_quality
from tessera.llm.queries import tokenizer_path
from tessera.llm.suffix_dedup import cut_repeats
from tessera.llm.tables import new_place, table
from tessera.sources.places import scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return reject_low_quality(docs, table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_predicted_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of a similarity of 0.8 or more stays (op1 takes 0.85, as its contract says)."""
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every stretch of 100 bytes or more that stands earlier, in the order of doc_id."""
    return cut_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the texts with their ids, and their places in sequences."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each reads what the one before it wrote.

    What a stage stores on its way goes when its documents are written; the last stage's goes with the caller's scope.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = new_place(spark, f"pipeline-{k}-{name.replace(' ', '-')}")
        with scope(spark):
            found = stage(spark, docs, sf_dir)
            found.write.option("compression", "zstd").parquet(kept)
        docs = spark.read.schema(found.schema).parquet(kept)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages rest on fitted models and token ids, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None
