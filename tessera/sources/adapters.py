"""The generic tables as the entities of a media catalog (formulas of FIXTURES.md, section 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.store import MODEL

APP = "gallery"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rid(number: Column | str) -> Column:
    """A record id: 'rec-' and eight digits."""
    return F.concat(F.lit("rec-"), F.lpad((F.col(number) if isinstance(number, str) else number).cast("string"), 8, "0"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, created_at, content_hash, size_bytes, doc_id, filename, type."""
    d = F.col("doc_id")
    extension = F.element_at(F.array(*map(F.lit, (".JPG", ".png", ".heic", "", ".", ".tar.gz", ".webp", ".bmp"))), (d % 8 + 1).cast("int"))
    name = F.when(d % 16 == 11, F.concat(F.lit("roll/."), F.lit("hidden"))).otherwise(F.concat(F.lit("roll.1/img-"), d.cast("string"), extension))
    return table(spark, sf_dir, "documents").select(
        rid("doc_id").alias("id"),
        F.when(d % 4 == 1, rid(d - 1)).when(d % 4 == 2, rid(d - 2)).alias("parent_id"),
        F.concat(F.date_add(F.to_date(F.lit("2024-01-01")), (d % 30).cast("int")).cast("string"), F.lit("T"), F.lpad((d % 24).cast("string"), 2, "0"), F.lit(":00:00")).alias("created_at"),
        F.sha2("text", 256).alias("content_hash"),
        F.col("n_chars").alias("size_bytes"),
        "doc_id",
        name.alias("filename"),
        F.when(d % 7 == 0, "image/png").when(d % 11 == 0, "video/mp4").otherwise("image/jpeg").alias("type"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, app_id, key, value: the app's own, those of another app, and curation values."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    d = F.col("doc_id")

    def some(rows: DataFrame, app: str, key: Column, value: Column) -> DataFrame:
        return rows.select(rid("doc_id").alias("record_id"), F.lit(app).alias("app_id"), key.alias("key"), value.alias("value"))

    own = some(docs.where(d.isNotNull() & (d % 4).isin(1, 2) & (d % 20 != 9)), APP, F.when(d % 4 == 1, "thumbnail").otherwise("crop"), F.lit(""))
    loose = some(docs.where(d % 16 == 3), APP, F.lit("crop"), F.lit(""))
    decoy = some(docs.where(d % 10 == 0), "other", F.lit("thumbnail"), F.lit(""))
    curated = some(table(spark, sf_dir, "labels"), "curation", F.lit("quality"), F.col("quality").cast("string"))
    return own.unionByName(loose).unionByName(decoy).unionByName(curated)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, width, height, captured_at, orientation; 0 or 1 row per record."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").where(d % 5 != 0).select(
        rid("doc_id").alias("record_id"),
        (F.lit(400) + (d * 37) % 3600).cast("int").alias("width"),
        (F.lit(300) + (d * 53) % 2700).cast("int").alias("height"),
        F.when(d % 3 == 0, F.concat(F.date_add(F.to_date(F.lit("2023-06-01")), (d % 60).cast("int")).cast("string"), F.lit("T12:00:00"))).alias("captured_at"),
        F.when(d % 9 > 0, (d % 9).cast("int")).alias("orientation"),
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, caption, date_taken_override: the app's own additions."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").where((d % 4 == 0) & (d % 7 == 0)).select(
        rid("doc_id").alias("record_id"),
        F.when(d % 8 == 0, F.concat(F.lit("cap "), d.cast("string"))).alias("caption"),
        F.when(d % 3 == 0, "2022-01-01T00:00:00").alias("date_taken_override"),
    )


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with what a listing may leave out: mime_type and original_filename."""
    d = F.col("doc_id")
    return records(spark, sf_dir).withColumns({"mime_type": F.when(d % 6 != 0, F.col("type")), "original_filename": F.when(d % 9 != 0, F.col("filename"))})


def camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, camera_make, camera_model, f_number, exposure_time, iso, lens_model, gps_lat, gps_lon."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").where(d % 5 != 0).select(
        rid("doc_id").alias("record_id"),
        F.when(d % 4 == 0, "").when(d % 4 != 3, F.concat(F.lit(" Maker "), (d % 3).cast("string"))).alias("camera_make"),
        F.when(d % 3 != 0, F.concat(F.lit("M"), (d % 7).cast("string"), F.lit(" "))).alias("camera_model"),
        F.when(d % 2 == 0, (d % 9).cast("double") / 2 + 1).alias("f_number"),
        F.when(d % 8 != 1, F.concat(F.lit("1/"), (d % 500 + 1).cast("string"), F.lit("s"))).alias("exposure_time"),
        F.when(d % 11 != 0, (d % 40 * 100).cast("int")).alias("iso"),
        F.when(d % 13 == 0, "wide").alias("lens_model"),
        F.when(d % 3 == 1, (d % 180).cast("double") - 90 + 0.125).alias("gps_lat"),
        F.when(d % 6 != 4, (d % 360).cast("double") - 180.0625).alias("gps_lon"),
    )


def sidecar_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id and body: JSON side files, current and stale ones, without faces, and such that can't be read."""
    d = F.col("doc_id")
    face = F.concat(F.lit('{"score":0.5,"personId":"'), (d % 10).cast("string"), F.lit('"}'))
    head = F.concat(F.lit('{"v":'), F.when(d % 14 == 0, "0").otherwise("1"), F.lit(',"model":"'), F.when(d % 21 == 0, "other").otherwise(MODEL), F.lit('","faces":'))
    body = F.when(d % 7 == 1, F.lit("not json")).when(d % 7 == 2, F.lit('{"v":1,"faces":{}}')).when(d % 7 == 3, F.concat(head, F.lit("[]}"))).when(d % 7 == 4, F.concat(head, F.lit("["), face, F.lit(","), face, F.lit("]}"))).otherwise(F.concat(head, F.lit("["), face, F.lit("]}")))
    return table(spark, sf_dir, "documents").where(d % 2 == 0).select(rid("doc_id").alias("record_id"), body.alias("body"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: vec_id, record_id, face_index, v, score, x, y, w, h, img, person_id, embedding."""
    k = F.col("vec_id")
    pair = F.floor(k / 2)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        rid(pair * 5).alias("record_id"),
        (k % 2).cast("int").alias("face_index"),
        F.when(pair % 11 == 0, 0).otherwise(1).alias("v"),
        (0.5 + F.col("label") / 20.0).alias("score"),
        ((k * 37) % 600).cast("double").alias("x"),
        ((k * 53) % 400).cast("double").alias("y"),
        (20 + (k % 7) * 10).cast("double").alias("w"),
        (20 + (k % 5) * 10).cast("double").alias("h"),
        F.floor(k / 25).alias("img"),
        F.col("label").cast("string").alias("person_id"),
        "embedding",
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, name, created_at: one per label of the vectors."""
    n = F.col("label").cast("int")
    return table(spark, sf_dir, "embeddings").select("label").distinct().select(
        n.cast("string").alias("person_id"),
        F.when(n == 8, F.repeat(F.lit("é"), 65)).when(n % 2 == 0, F.concat(F.lit("  Person "), n.cast("string"), F.lit("  "))).otherwise("").alias("name"),
        F.concat(F.lit("2024-02-"), F.lpad((F.lit(28) - n % 3).cast("string"), 2, "0")).alias("created_at"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, event_id, ts, event_type, value: a feed of changes."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "ts", "event_type", "value")


#: The same entities for DuckDB, as common table expressions.
SQL = {
    "records": """records AS (SELECT 'rec-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id,
  CASE doc_id % 4 WHEN 1 THEN 'rec-' || lpad(CAST(doc_id - 1 AS VARCHAR), 8, '0') WHEN 2 THEN 'rec-' || lpad(CAST(doc_id - 2 AS VARCHAR), 8, '0') END AS parent_id,
  CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS VARCHAR) || 'T' || lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || ':00:00' AS created_at,
  sha256(text) AS content_hash, n_chars AS size_bytes, doc_id,
  CASE WHEN doc_id % 16 = 11 THEN 'roll/.hidden' ELSE 'roll.1/img-' || doc_id || (['.JPG', '.png', '.heic', '', '.', '.tar.gz', '.webp', '.bmp'])[doc_id % 8 + 1] END AS filename,
  CASE WHEN doc_id % 7 = 0 THEN 'image/png' WHEN doc_id % 11 = 0 THEN 'video/mp4' ELSE 'image/jpeg' END AS type
  FROM documents)""",
    "listed": """listed AS (SELECT *, CASE WHEN doc_id % 6 <> 0 THEN type END AS mime_type, CASE WHEN doc_id % 9 <> 0 THEN filename END AS original_filename FROM records)""",
    "camera": """camera AS (SELECT 'rec-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS record_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 <> 3 THEN ' Maker ' || (doc_id % 3) END AS camera_make,
  CASE WHEN doc_id % 3 <> 0 THEN 'M' || (doc_id % 7) || ' ' END AS camera_model, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 9 AS DOUBLE) / 2 + 1 END AS f_number, CASE WHEN doc_id % 8 <> 1 THEN '1/' || (doc_id % 500 + 1) || 's' END AS exposure_time,
  CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id % 40 * 100 AS INTEGER) END AS iso, CASE WHEN doc_id % 13 = 0 THEN 'wide' END AS lens_model,
  CASE WHEN doc_id % 3 = 1 THEN CAST(doc_id % 180 AS DOUBLE) - 90 + 0.125 END AS gps_lat, CASE WHEN doc_id % 6 <> 4 THEN CAST(doc_id % 360 AS DOUBLE) - 180.0625 END AS gps_lon FROM documents WHERE doc_id % 5 <> 0)""",
    "sidecars": f"""sidecars AS (SELECT 'rec-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS record_id, doc_id, CASE WHEN doc_id % 14 = 0 THEN 0 ELSE 1 END AS v, CASE WHEN doc_id % 21 = 0 THEN 'other' ELSE '{MODEL}' END AS model,
  CASE doc_id % 7 WHEN 3 THEN 0 WHEN 4 THEN 2 ELSE 1 END AS n_faces, CAST(doc_id % 10 AS VARCHAR) AS person_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 7 NOT IN (1, 2))""",
    "rlabels": """rlabels AS (SELECT 'rec-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS record_id, app_id, key, value FROM (
  SELECT doc_id, 'gallery' AS app_id, CASE WHEN doc_id % 4 = 1 THEN 'thumbnail' ELSE 'crop' END AS key, '' AS value FROM documents WHERE doc_id % 4 IN (1, 2) AND doc_id % 20 <> 9
  UNION ALL SELECT doc_id, 'gallery', 'crop', '' FROM documents WHERE doc_id % 16 = 3
  UNION ALL SELECT doc_id, 'other', 'thumbnail', '' FROM documents WHERE doc_id % 10 = 0
  UNION ALL SELECT doc_id, 'curation', 'quality', CAST(quality AS VARCHAR) FROM labels))""",
    "metadata": """metadata AS (SELECT 'rec-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS record_id,
  CAST(400 + (doc_id * 37) % 3600 AS INTEGER) AS width, CAST(300 + (doc_id * 53) % 2700 AS INTEGER) AS height,
  CASE WHEN doc_id % 3 = 0 THEN CAST(DATE '2023-06-01' + CAST(doc_id % 60 AS INTEGER) AS VARCHAR) || 'T12:00:00' END AS captured_at,
  CASE WHEN doc_id % 9 > 0 THEN CAST(doc_id % 9 AS INTEGER) END AS orientation FROM documents WHERE doc_id % 5 <> 0)""",
    "enriched": """enriched AS (SELECT 'rec-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS record_id,
  CASE WHEN doc_id % 8 = 0 THEN 'cap ' || doc_id END AS caption, CASE WHEN doc_id % 3 = 0 THEN '2022-01-01T00:00:00' END AS date_taken_override
  FROM documents WHERE doc_id % 4 = 0 AND doc_id % 7 = 0)""",
    "faces": """faces AS (SELECT vec_id, 'rec-' || lpad(CAST((vec_id // 2) * 5 AS VARCHAR), 8, '0') AS record_id, CAST(vec_id % 2 AS INTEGER) AS face_index,
  CASE WHEN (vec_id // 2) % 11 = 0 THEN 0 ELSE 1 END AS v, 0.5::DOUBLE + label / 20.0::DOUBLE AS score,
  CAST((vec_id * 37) % 600 AS DOUBLE) AS x, CAST((vec_id * 53) % 400 AS DOUBLE) AS y, CAST(20 + (vec_id % 7) * 10 AS DOUBLE) AS w, CAST(20 + (vec_id % 5) * 10 AS DOUBLE) AS h,
  vec_id // 25 AS img, CAST(label AS VARCHAR) AS person_id, embedding FROM embeddings)""",
    "people": """people AS (SELECT CAST(label AS VARCHAR) AS person_id, CASE WHEN label = 8 THEN repeat('é', 65) WHEN label % 2 = 0 THEN '  Person ' || label || '  ' ELSE '' END AS name,
  '2024-02-' || lpad(CAST(28 - label % 3 AS VARCHAR), 2, '0') AS created_at FROM (SELECT DISTINCT label FROM embeddings))""",
    "changes": "changes AS (SELECT user_id AS id, event_id, ts, event_type, value FROM events)",
}
