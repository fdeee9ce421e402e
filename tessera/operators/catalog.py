"""Catalog reads: assembly, label predicates, derivation kinds, paging and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import aperture_text, camera_text, content_key, date_text, place_text
from tessera.operators.ranges import ranked

KINDS = ("thumbnail", "crop")


def rendered(app: Column | str = "app_id", key: Column | str = "key") -> Column:
    """A label as it is shown: app/key."""
    return F.concat_ws("/", app, key)


def assembled(records: DataFrame, metadata: DataFrame, enriched: DataFrame) -> DataFrame:
    """Records with 0..1 metadata and, for records without a parent, 0..1 enrichment.

    Widths and heights default to 0; effective_date is override, else captured_at, else created_at (null only).
    """
    extra = enriched.withColumnRenamed("record_id", "e_id")
    return (
        records.join(metadata, records.id == metadata.record_id, "left")
        .join(extra, (F.col("id") == F.col("e_id")) & F.col("parent_id").isNull(), "left")
        .select(
            *records.columns,
            F.coalesce("width", F.lit(0)).alias("width"),
            F.coalesce("height", F.lit(0)).alias("height"),
            "orientation",
            "caption",
            F.coalesce("date_taken_override", "captured_at", "created_at").alias("effective_date"),
        )
    )


def with_labels(records: DataFrame, labels: DataFrame) -> DataFrame:
    """records with ``labels``: the sorted array of their labels; empty where there are none."""
    own = labels.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("app_id", "key", "value"))).alias("labels"))
    kind = own.schema["labels"].dataType
    return records.join(own, records.id == own.record_id, "left").withColumn("labels", F.coalesce("labels", F.array().cast(kind))).drop("record_id")


def derived_kind(records: DataFrame, labels: DataFrame, app: str) -> DataFrame:
    """records with ``kind``: thumbnail or crop by the app's own labels (the first in the order of keys), else null."""
    own = labels.where((F.col("app_id") == app) & F.col("key").isin(*KINDS)).groupBy("record_id").agg(F.min("key").alias("kind"))
    return records.join(own, records.id == own.record_id, "left").drop("record_id")


def originals(records: DataFrame, labels: DataFrame, app: str) -> DataFrame:
    """Records without a parent and without a label of the app that marks a derived one."""
    own = labels.where((F.col("app_id") == app) & F.col("key").isin(*KINDS)).select(F.col("record_id").alias("id"))
    return records.where("parent_id is null").join(own, "id", "left_anti")


def having_label(records: DataFrame, labels: DataFrame, app: str, key: str, value: str | None = None) -> DataFrame:
    """Records with a label app/key, of the value if one is given."""
    wanted = labels.where((F.col("app_id") == app) & (F.col("key") == key))
    wanted = wanted if value is None else wanted.where(F.col("value") == value)
    return records.join(wanted.select(F.col("record_id").alias("id")), "id", "left_semi")


def of_types(records: DataFrame, granted: DataFrame) -> DataFrame:
    """Records of granted types (column ``type``)."""
    return records.join(granted.select("type"), "type", "left_semi")


def page(records: DataFrame, after: str | None, size: int) -> DataFrame:
    """A page by key: the next ``size`` records after a cursor, in the order of id."""
    rest = records if after is None else records.where(F.col("id") > after)
    return rest.orderBy("id").limit(size)


def changed_since(records: DataFrame, cursor: str | None, size: int = 500) -> DataFrame:
    """Records changed after a cursor (exclusive), oldest first; all for no cursor. At most ``size``."""
    rest = records if not cursor else records.where(F.col("created_at") > cursor)
    return rest.orderBy("created_at", "id").limit(size)


def can_thumbnail(records: DataFrame, targets: DataFrame, labels: DataFrame, app: str) -> DataFrame:
    """targets (id) with ``allowed``: false only for known records that are thumbnails."""
    known = derived_kind(records, labels, app).select("id", "kind")
    return targets.join(known, "id", "left").select("id", F.coalesce(F.col("kind") != "thumbnail", F.lit(True)).alias("allowed"))


def thumbnail_of(records: DataFrame, labels: DataFrame, app: str) -> DataFrame:
    """parent_id and thumbnail_id: the first thumbnail, in the order of id, of each parent."""
    marked = derived_kind(records, labels, app).where("kind = 'thumbnail' and parent_id is not null")
    return marked.groupBy("parent_id").agg(F.min("id").alias("thumbnail_id"))


def shown_original(records: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (id, parent_id) with ``shown_id``: the parent where it is known, else the record itself."""
    parents = records.select(F.col("id").alias("p_id"))
    return chosen.join(parents, F.col("parent_id") == F.col("p_id"), "left").select("id", F.coalesce("p_id", "id").alias("shown_id"))


def lookup_batches(ids: DataFrame, records: DataFrame, size: int = 100, ranges: int | None = None) -> DataFrame:
    """Distinct ids that exist, with their object key, and the batch of a request: ``size`` distinct ids each, by id."""
    numbered = ranked(ids.select("id").distinct(), "id", ranges).select("id", F.floor(F.col("rank") / size).alias("batch"))
    return numbered.join(records.select("id", "content_hash"), "id").select("id", "batch", "content_hash")


def requested(records: DataFrame, seen: DataFrame) -> DataFrame:
    """Records that were asked for (id), once each."""
    return records.join(seen.select("id"), "id", "left_semi")


def app_row(enriched: DataFrame, record_id: str) -> DataFrame:
    """The app's own row of a record, if there is one; of several the first by all columns."""
    return enriched.where(F.col("record_id") == record_id).orderBy(*enriched.columns).limit(1)


EXIF = ("captured_at", "camera_make", "camera_model", "f_number", "exposure_time", "iso", "lens_model", "gps_lat", "gps_lon", "orientation")


def app_images(records: DataFrame, labels: DataFrame, metadata: DataFrame, camera: DataFrame, enriched: DataFrame, app: str) -> DataFrame:
    """Records as the app shows them: kind, size, ``exif`` (a struct, null fields where there is no metadata), names and dates.

    mime_type defaults to image/jpeg, original_filename to the id, width and height to 0.
    """
    typed = derived_kind(records, labels, app)
    extra = metadata.join(camera, "record_id", "full_outer").withColumnRenamed("record_id", "m_id")
    own = enriched.withColumnRenamed("record_id", "e_id")
    joined = typed.join(extra, F.col("id") == F.col("m_id"), "left").join(own, (F.col("id") == F.col("e_id")) & F.col("parent_id").isNull(), "left")
    return joined.select(
        "id",
        F.coalesce("mime_type", F.lit("image/jpeg")).alias("mime_type"),
        content_key(F.col("type"), F.col("content_hash")).alias("object_key"),
        "size_bytes",
        "created_at",
        "parent_id",
        F.col("kind").alias("derived_kind"),
        F.coalesce("width", F.lit(0)).alias("width"),
        F.coalesce("height", F.lit(0)).alias("height"),
        F.struct(*EXIF).alias("exif"),
        F.coalesce("original_filename", "id").alias("original_filename"),
        F.coalesce("date_taken_override", "captured_at", "created_at").alias("effective_date"),
        "caption",
        "date_taken_override",
    )


def info_panel(images: DataFrame) -> DataFrame:
    """The texts of the info panel of app_images; null where there is nothing to show."""
    exif = F.col("exif")
    return images.select(
        "id",
        "original_filename",
        F.concat(F.col("width").cast("string"), F.lit(" × "), F.col("height").cast("string"), F.lit("px")).alias("dimensions"),
        date_text(F.col("effective_date")).alias("date_taken"),
        camera_text(exif["camera_make"], exif["camera_model"]).alias("camera"),
        aperture_text(exif["f_number"]).alias("aperture"),
        F.nullif(exif["exposure_time"], F.lit("")).alias("exposure"),
        exif["iso"].alias("iso"),
        place_text(exif["gps_lat"], exif["gps_lon"]).alias("place"),
    )
