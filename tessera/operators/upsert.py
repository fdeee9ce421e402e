"""Writes as plans: upserts, content-addressed inserts, derived records, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import content_key, crop_rectangle, utf16_units

MOST_CAPTION = 2000


def latest(changes: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last change of each key."""
    return changes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def upserted(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """existing with incoming rows in the place of those of the same key, new ones added. Both have the same columns."""
    both = existing.select(F.col(key), F.struct(*existing.columns).alias("old")).join(incoming.select(F.col(key), F.struct(*existing.columns).alias("new")), key, "full_outer")
    return both.select(F.coalesce("new", "old").alias("row")).select("row.*")


def patched(existing: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """existing after patches: a column c changes only where ``has_c`` is true; rows of unknown keys are added.

    Empty texts become null; a patch with a text of over 2000 UTF-16 units is refused whole.
    """
    fits = [F.coalesce(~F.col(f"has_{c}") | (utf16_units(F.col(c)) <= MOST_CAPTION), F.lit(True)) for c in columns]
    good = patches
    for f in fits:
        good = good.where(f)
    new = good.select(key, *[F.nullif(F.col(c), F.lit("")).alias(f"new_{c}") for c in columns], *[f"has_{c}" for c in columns])
    both = existing.join(new, key, "full_outer")
    return both.select(key, *[F.when(F.coalesce(f"has_{c}", F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def content_inserts(records: DataFrame) -> DataFrame:
    """id, content_hash, object_key, deduped, first_id: a record is deduped if an earlier id has its content."""
    first = records.groupBy("content_hash").agg(F.min("id").alias("first_id"))
    return records.select("id", "type", "content_hash").join(first, "content_hash").select("id", "content_hash", content_key(F.col("type"), F.col("content_hash")).alias("object_key"), (F.col("id") != F.col("first_id")).alias("deduped"), "first_id")


def labels_added(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels are added, never replaced."""
    return labels.unionByName(more).distinct()


def thumbnails_due(kinds: DataFrame) -> DataFrame:
    """target_id, thumbnail_id: records (id, parent_id, kind) that may have a thumbnail and have none yet."""
    has = kinds.where("kind = 'thumbnail' and parent_id is not null").select(F.col("parent_id").alias("id"))
    return kinds.where("kind is null or kind <> 'thumbnail'").join(has, "id", "left_anti").select(F.col("id").alias("target_id"), F.concat(F.lit("thumb-"), "id").alias("thumbnail_id"))


def crop_records(boxes: DataFrame, width: Column, height: Column, app: str) -> DataFrame:
    """A new record for each box (record_id, face_index, x, y, w, h): its id, parent, type, label, and size as metadata."""
    r = crop_rectangle(*[F.col(c) for c in "xywh"], width, height)
    return boxes.select(
        F.concat(F.lit("crop-"), "record_id", F.lit("-"), F.col("face_index").cast("string")).alias("id"),
        F.col("record_id").alias("parent_id"),
        F.lit("image/jpeg").alias("type"),
        F.lit(app).alias("app_id"),
        F.lit("crop").alias("key"),
        r["width"].alias("width"),
        r["height"].alias("height"),
    )


def metadata_writes(metadata: DataFrame, columns: list[str]) -> DataFrame:
    """record_id, field, value: the fields that aren't null; rows without any aren't written."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return metadata.select("record_id", F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p")).select("record_id", "p.field", "p.value")


def deleted(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id"), "id", "left_anti")
