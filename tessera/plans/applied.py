"""Registered queries of requests, applied writes, files and keyed state, each beside its SQL."""

from __future__ import annotations

from functools import reduce
from urllib.parse import urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import exif
from tessera.operators import catalog, detection, publish, requests, similar, store, writes
from tessera.operators import library_clusters as clusters_of_all
from tessera.plans.oracles import DOT, MORE, ORACLE_SQL, clusters, sql
from tessera.plans.queries import APP, patches, query
from tessera.sources import adapters as src
from tessera.sources import downloads
from tessera.sources import sidecars as files
from tessera.sources.adapters import SQL
from tessera.sources.file_store import read_files, write_files
from tessera.sources.places import written
from tessera.streaming import freshness, keyed
from tessera.streaming.versioned import VersionedTable

#: Requests as limit, cursor, include, updated_after, label, labelValue; their query strings are made from these.
ASKED = (
    (None, None, None, None, None, None), (500, None, "metadata,labels", None, None, None), (500, None, "metadata,labels", "2024-01-20T00:00:00", None, None), (200, None, "labels", None, None, None),
    (200, "rec-00000100", "labels", None, None, None), (200, "rec-00000400", "labels", None, None, None), (1, None, "metadata", None, None, None), (1, "rec-00000001", "metadata", None, None, None),
    (25, None, "labels", None, f"{APP}/crop", None), (25, "rec-00000049", "labels", None, f"{APP}/crop", None), (25, None, None, "2024-01-10", f"{APP}/crop", None), (1000, None, None, None, f"{APP}/thumbnail", ""),
    (1000, None, "labels", None, "curation/quality", None), (40, None, "metadata", None, "curation/quality", "1"), (40, "rec-00000120", "labels", None, "curation/quality", "0"), (40, None, None, "2024-01-25", "curation/quality", "1"),
    (500, None, None, None, "curation/quality", "' OR '1'='1"), (500, None, None, None, "other/thumbnail", None), (500, None, None, None, "other/crop", None), (500, "zzz", "labels", None, None, None),
    (500, None, None, "2999-01-01", None, None), (3, "rec-00000010", "metadata,labels", "2024-01-15T12:00:00", "other/thumbnail", ""), (1000, None, None, "2024-01-30", None, None), (7, "rec-0000002", "labels", None, None, None),
)
NAMES = ("limit", "cursor", "include", "updated_after", "label", "labelValue")


@query
def catalog_requests(spark, d):
    """A page for each request, from its query string, over a catalog that is written once, so that predicates reach its files."""
    records = written(src.records(spark, d).select("id", "created_at", "type"), "records")
    labels, metadata = written(src.labels(spark, d), "labels"), written(src.metadata(spark, d), "metadata")

    def page(k: int, asked: tuple) -> DataFrame:
        text = "/data/records?" + urlencode({n: v for n, v in zip(NAMES, asked) if v is not None})
        found = requests.answered(text, records, labels, metadata, ["image/jpeg", "image/png"], "created_at")
        return found.select(F.lit(k).alias("request"), "id", "next_cursor", F.col("metadata.width").alias("width"), requests.rendered_labels(F.col("labels")).alias("labels"))

    return reduce(DataFrame.unionByName, [page(k, asked) for k, asked in enumerate(ASKED)])


def page_sql(k: int, limit, cursor, include, updated, label, value) -> str:
    quoted = lambda x: "'" + (x or "").replace("'", "''") + "'"
    where = ["type IN ('image/jpeg', 'image/png')"] + [f"id > {quoted(cursor)}"] * (cursor is not None) + [f"created_at > {quoted(updated)}"] * (updated is not None)
    if label is not None:
        app, key = label.split("/")
        where.append(f"id IN (SELECT record_id FROM rlabels WHERE app_id = {quoted(app)} AND key = {quoted(key)}" + (f" AND value = {quoted(value)}" if value is not None else "") + ")")
    n, parts = limit or requests.DEFAULT, include or ""
    width = "(SELECT min(width) FROM metadata WHERE record_id = id)" if "metadata" in parts else "CAST(NULL AS INTEGER)"
    shown = "(SELECT coalesce(string_agg(app_id || '/' || key || '=' || value, ',' ORDER BY app_id, key, value), '') FROM rlabels WHERE record_id = id)" if "labels" in parts else "CAST(NULL AS VARCHAR)"
    return f"""SELECT {k} AS request, id, max(CASE WHEN n = {n} AND more THEN id END) OVER () AS next_cursor, {width} AS width, {shown} AS labels
FROM (SELECT id, row_number() OVER (ORDER BY id) AS n, lead(id) OVER (ORDER BY id) IS NOT NULL AS more FROM records WHERE {' AND '.join(where)}) WHERE n <= {n}"""


ORACLE_SQL["catalog_requests"] = sql("records rlabels metadata", "\nUNION ALL ".join(page_sql(k, *asked) for k, asked in enumerate(ASKED)))


def standing_labels(spark, d) -> DataFrame:
    """Values that stand before anything is published: record_id, key, value."""
    faces = src.faces(spark, d)
    count = faces.where("vec_id % 3 = 0").select("record_id", F.lit("faceCount").alias("key"), F.lit("2").alias("value"))
    return count.unionByName(faces.where("vec_id % 5 = 0").select("record_id", F.lit("faces").alias("key"), F.lit("Old").alias("value"))).distinct()


@query
def labels_applied(spark, d):
    """The labels that stand after publishing, after a person is renamed, and after all is retracted: three versions of one table."""
    table = VersionedTable(spark, freshness.folder(spark, "labels"))
    table.create(standing_labels(spark, d), "record_id", 8)
    faces, people = store.current(src.faces(spark, d)), src.people(spark, d)
    renamed = people.withColumn("name", F.when(F.col("person_id") == "4", "Zoe").otherwise(F.col("name")))
    states = []
    for step, desired in enumerate((publish.publish_plan(faces, people), publish.publish_plan(faces, renamed), publish.retract_plan(faces))):
        writes.set_values(table, desired)
        states.append(table.read().withColumn("step", F.lit(step)))
    return reduce(DataFrame.unionByName, states)


_OLD = "old AS (SELECT DISTINCT * FROM (SELECT record_id, 'faceCount' AS key, '2' AS value FROM faces WHERE vec_id % 3 = 0 UNION ALL SELECT record_id, 'faces', 'Old' FROM faces WHERE vec_id % 5 = 0))"
_ZOE = "people2 AS (SELECT * REPLACE (CASE WHEN person_id = '4' THEN 'Zoe' ELSE name END AS name) FROM people), " + MORE["names"].replace("names AS", "names2 AS").replace("FROM people", "FROM people2") + ", " + MORE["plan"].replace("plan AS", "plan2 AS").replace("JOIN names", "JOIN names2")
ORACLE_SQL["labels_applied"] = sql(
    "plan",
    f""", {_OLD}, {_ZOE}, rest AS (SELECT * FROM old WHERE record_id NOT IN (SELECT record_id FROM plan))
SELECT 0 AS step, * FROM rest UNION ALL SELECT 0, record_id, key, unnest(vals) FROM plan
UNION ALL SELECT 1, * FROM rest UNION ALL SELECT 1, record_id, key, unnest(vals) FROM plan2 UNION ALL SELECT 2, * FROM rest""",
).replace("\n,", ",", 1)


@query
def enrichment_applied(spark, d):
    """The app's own rows after partial upserts and after the deletion of all videos."""
    table = VersionedTable(spark, freshness.folder(spark, "enriched"))
    table.create(src.enriched(spark, d), "record_id", 4)
    writes.apply_patches(table, patches(spark, d), ["caption", "date_taken_override"])
    first = table.read().withColumn("step", F.lit(0))
    writes.apply_deletes(table, src.records(spark, d).where("type = 'video/mp4'").select(F.col("id").alias("record_id")))
    return first.unionByName(table.read().withColumn("step", F.lit(1)))


_PATCHED = ORACLE_SQL["partial_upsert"].rsplit("SELECT record_id, CASE", 1)
ORACLE_SQL["enrichment_applied"] = f"WITH RECURSIVE {SQL['records']}, {_PATCHED[0].removeprefix('WITH RECURSIVE ').rstrip()}, done AS (SELECT record_id, CASE{_PATCHED[1]}) SELECT 0 AS step, * FROM done UNION ALL SELECT 1, * FROM done WHERE record_id NOT IN (SELECT id FROM records WHERE type = 'video/mp4')"


@query
def cursor_synced(spark, d):
    """A snapshot that follows the feed in three runs, each from the cursor that the one before has stored."""
    feed = src.changes(spark, d)
    table = VersionedTable(spark, freshness.folder(spark, "synced"))
    low, high = feed.agg(F.min("ts"), F.max("ts")).first()
    for part in (low + (high - low) / 3, low + (high - low) * 2 / 3, high):
        freshness.synced(table, feed.where(F.col("ts") <= F.lit(part)))
    return table.read().select("id", "event_id", "event_type", F.lit(table.version().marks["cursor"]).cast("timestamp_ntz").alias("cursor"))


ORACLE_SQL["cursor_synced"] = sql("latest", "SELECT id, event_id, event_type, (SELECT max(ts) FROM changes) AS cursor FROM latest")


@query
def sidecar_files(spark, d):
    """Side files written one for each record of the detections, some again, and read back through the data source."""
    faces = src.faces(spark, d)
    face = F.struct("score", F.col("person_id").alias("personId"), F.array("x", "y", "w", "h").alias("bbox"))
    found = faces.groupBy("record_id", "v").agg(F.array_sort(F.collect_list(F.struct("face_index", face.alias("face")))).alias("f"))
    body = F.to_json(F.struct(F.col("v"), F.lit(store.MODEL).alias("model"), F.transform("f", lambda x: x["face"]).alias("faces")))
    place = freshness.folder(spark, "sidecars")
    write_files(found.select("record_id", body.alias("body")), place)
    stale = found.where("v = 0").select("record_id", F.lit("half a fi").alias("body"))
    write_files(stale.unionByName(found.where("size(f) = 1").select("record_id", F.lit('{"v":2,"model":"next","faces":[]}').alias("body"))), place)
    read = files.parsed(read_files(spark, place, files=64))
    return read.select("record_id", "v", "model", F.size("faces").cast("long").alias("n_faces"), F.array_join(F.transform("faces", lambda f: f["personId"]), ",").alias("people"), F.get("faces", F.lit(0))["bbox"][2].alias("width"))


ORACLE_SQL["sidecar_files"] = sql(
    "faces",
    f""", f AS (SELECT record_id, v, count(*) AS n, string_agg(person_id, ',' ORDER BY face_index, score, person_id) AS people, min_by(w, (face_index, score, person_id)) AS width FROM faces GROUP BY 1, 2)
SELECT record_id, CAST(CASE WHEN n = 1 THEN 2 ELSE v END AS INTEGER) AS v, CASE WHEN n = 1 THEN 'next' ELSE '{store.MODEL}' END AS model, CASE WHEN n = 1 THEN 0 ELSE n END AS n_faces,
 CASE WHEN n = 1 THEN '' ELSE people END AS people, CASE WHEN n > 1 THEN width END AS width FROM f WHERE v = 1 OR n = 1""",
).replace("\n,", ",", 1)


@query
def checked_files(spark, d):
    """Files on disk (one is written for each part, some cut, changed, missing or unexpected) held against their sizes and digests."""
    k, body = F.col("p_partkey"), F.repeat(F.concat("p_name", F.lit(" "), "p_type"), 7)
    parts = src.table(spark, d, "part").select("p_partkey", F.concat(F.lit("model "), k.cast("string"), F.lit(".bin")).alias("name"), body.alias("text"))
    on_disk = F.when(k % 10 == 0, F.substring("text", 1, 20)).when(k % 7 == 0, F.reverse("text")).otherwise(F.col("text"))
    place = freshness.folder(spark, "files")
    found = parts.where(k % 15 != 0).select(F.regexp_replace("name", r"\.bin$", "").alias("record_id"), on_disk.alias("body"))
    write_files(found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "record_id"), place, suffix=".bin")
    expected = parts.where(k % 21 != 0).select(F.replace("name", F.lit(" "), F.lit("%20")).alias("name"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    downloads.checked(spark, place, expected, most=400).write.parquet(place + "-status")
    status = spark.read.parquet(place + "-status")
    downloads.quarantined(status.where("status in ('size', 'digest')"), place, place + "-aside")
    left = downloads.listed(spark, place).select("name", F.lit(True).alias("left"))
    return status.join(left.hint("merge"), "name", "left").select("name", "status", F.coalesce("left", F.lit(False)).alias("left"))


ORACLE_SQL["checked_files"] = """
WITH parts AS (SELECT p_partkey AS k, 'model%20' || p_partkey || '.bin' AS name, repeat(p_name || ' ' || p_type, 7) AS text FROM part),
disk AS (SELECT name, CASE WHEN k % 10 = 0 THEN substr(text, 1, 20) WHEN k % 7 = 0 THEN reverse(text) ELSE text END AS body FROM parts WHERE k % 15 <> 0),
known AS (SELECT name, strlen(text) AS size, sha256(text) AS digest FROM parts WHERE k % 21 <> 0)
SELECT name, status, status IN ('ok', 'too large', 'unexpected') AS left FROM (SELECT name, CASE WHEN size IS NULL THEN 'unexpected' WHEN body IS NULL THEN 'missing'
 WHEN strlen(body) <> size THEN 'size' WHEN size > 400 THEN 'too large' WHEN sha256(body) = digest THEN 'ok' ELSE 'digest' END AS status FROM known FULL JOIN disk USING (name))"""


@query
def exif_bytes(spark, d):
    """EXIF fields read from the bytes of files: TIFF or JPEG, in both byte orders, some cut short and some without any."""
    k = F.col("doc_id")
    date = F.concat(F.translate(F.substring("created_at", 1, 10), "-", ":"), F.lit(" "), F.substring("created_at", 12, 8))
    tiff = exif.tiff_bytes(
        k % 2 == 0, F.concat(F.lit("Maker "), (k % 3).cast("string")), F.concat(F.lit("Model "), (k % 1000).cast("string")), F.concat(F.lit("Lens "), "filename"), date, k % 8 + 1, (F.lit(1), k % 500 + 1), (k % 80 + 10, F.when(k % 17 == 0, 0).otherwise(10)),
        k % 64 * 50, [k % 90, k % 60, k % 59], F.when(k % 3 == 0, "S").otherwise("N"), [k % 180, k % 58, k % 57], F.when(k % 5 == 0, "W").otherwise("E"),
    )
    whole = F.when(k % 4 < 2, exif.in_jpeg(tiff)).otherwise(tiff)
    content = F.when(k % 13 == 0, F.encode("filename", "UTF-8")).when(k % 11 == 0, F.substring(whole, 1, 200)).otherwise(whole)
    return src.records(spark, d).select("id", exif.exif_fields(content).alias("raw")).select("id", *[(F.round(c, 6) if n.startswith("gps") else c).alias(n) for n, c in exif.exif_columns(F.col("raw")).items()])


_SEEN = "CASE WHEN doc_id % 13 <> 0 AND doc_id % 11 <> 0 THEN {0} END AS {1}"
ORACLE_SQL["exif_bytes"] = sql(
    "records",
    "SELECT id, "
    + ", ".join(
        _SEEN.format(body, name)
        for name, body in {
            "captured_at": "substr(created_at, 1, 19)", "camera_make": "'Maker ' || (doc_id % 3)", "camera_model": "'Model ' || (doc_id % 1000)", "f_number": "CASE WHEN doc_id % 17 <> 0 THEN (doc_id % 80 + 10) / 10.0::DOUBLE END",
            "exposure_time": "CASE WHEN doc_id % 500 = 0 THEN '1s' ELSE '1/' || (doc_id % 500 + 1) || 's' END", "iso": "CAST(doc_id % 64 * 50 AS DOUBLE)", "lens_model": "'Lens ' || filename",
            "gps_lat": "round((doc_id % 90 + (doc_id % 60) / 60.0::DOUBLE + (doc_id % 59) / 3600.0::DOUBLE) * CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END, 6)",
            "gps_lon": "round((doc_id % 180 + (doc_id % 58) / 60.0::DOUBLE + (doc_id % 57) / 3600.0::DOUBLE) * CASE WHEN doc_id % 5 = 0 THEN -1 ELSE 1 END, 6)", "orientation": "CAST(doc_id % 8 + 1 AS DOUBLE)",
        }.items()
    )
    + " FROM records",
)


@query
def similar_pairs(spark, d):
    """All pairs of the table with a similarity of 0.4 or more, between the smallest ids of equal vectors."""
    found, _ = similar.similar_pairs(src.table(spark, d, "embeddings"), 0.4)
    return found.withColumn("score", F.round("score", 6))


ORACLE_SQL["similar_pairs"] = f"""
WITH reps AS (SELECT min(vec_id) AS id, embedding AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY embedding),
pairs AS (SELECT p.id AS a, q.id AS b, {DOT.format('p.v', 'q.v')} AS score FROM reps p JOIN reps q ON p.id < q.id AND len(p.v) = len(q.v))
SELECT a, b, round(score, 6) AS score FROM pairs WHERE score >= 0.4"""


@query
def nms_rounds(spark, d):
    """Suppression of all images at once, in rounds over the overlaps."""
    return detection.suppressed_in_rounds(detection.corners(src.faces(spark, d)), 0.1)


ORACLE_SQL["nms_rounds"] = ORACLE_SQL["nms_keep"]


FED_ROWS = 1 << 18


def fed(spark, d, name: str, more: dict) -> DataFrame:
    """A stream over the changes, written in three parts by time, about one micro-batch each.

    A part has a file for each ``FED_ROWS`` changes of a third of all, and an id's changes of a part are in one file; so files come in an order that is right for each id.
    """
    changes = src.changes(spark, d).withColumns(more)
    low, high, n = changes.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    files = max(1, -(-n // (3 * FED_ROWS)))
    cuts = [low + (high - low) * k / 3 for k in (1, 2)]
    part = reduce(lambda n, c: n + (F.col("ts") > F.lit(c)).cast("int"), cuts, F.lit(0))
    place = freshness.folder(spark, name)
    for k in range(3):
        some = changes.where(part == k)
        (some.coalesce(1) if files == 1 else some.repartition(files, "id")).write.mode("append").parquet(place)
    return spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", files).parquet(place)


@query
def toggle_edges_streamed(spark, d):
    """Toggle edges by keyed state, over three micro-batches."""
    log = fed(spark, d, "flags", {"flag": F.coalesce(F.col("event_id") % 3 > 0, F.lit(False))}).select("id", "event_id", "ts", "flag")
    return keyed.toggle_edges(log, freshness.folder(spark, "edges"), spark.sparkContext.defaultParallelism)


ORACLE_SQL["toggle_edges_streamed"] = ORACLE_SQL["toggle_edges"]


@query
def arrival_snapshot(spark, d):
    """The newest change of each id, in the order in which ids first arrived, by keyed state over three micro-batches."""
    found = keyed.arrival_snapshot(fed(spark, d, "arrivals", {}), freshness.folder(spark, "arrived"), spark.sparkContext.defaultParallelism)
    return found.select("id", "event_id", "event_type", "arrived_event")


ORACLE_SQL["arrival_snapshot"] = sql("latest", "SELECT id, event_id, event_type, (SELECT min_by(c.event_id, (c.ts, c.event_id)) FROM changes c WHERE c.id = latest.id) AS arrived_event FROM latest")


@query
def pass_observed(spark, d):
    """The counters of a pass, observed while its work list is written; the list is read back."""
    place = freshness.folder(spark, "pass")
    counts = store.planned_pass(catalog.originals(src.records(spark, d), src.labels(spark, d), APP), src.faces(spark, d), place)
    due = spark.read.parquet(place).groupBy("outcome").agg(F.count("*").alias("written"))
    found = spark.createDataFrame([(o, n) for o, n in counts.items()], "outcome string, n long")
    return found.join(due, "outcome", "left").select("outcome", "n", F.coalesce("written", F.lit(0).cast("long")).alias("written"))


ORACLE_SQL["pass_observed"] = sql(
    "originals faces",
    """, o AS (SELECT CASE WHEN v = 1 THEN 'skipped' WHEN v IS NOT NULL THEN 'stale' ELSE 'new' END AS outcome FROM originals LEFT JOIN (SELECT record_id AS id, max(v) AS v FROM faces GROUP BY 1) USING (id))
SELECT name AS outcome, (SELECT count(*) FROM o WHERE outcome = name OR name = 'eligible') AS n, (SELECT count(*) FROM o WHERE outcome = name AND name <> 'skipped') AS written FROM (SELECT unnest(['eligible', 'skipped', 'stale', 'new']) AS name)""",
).replace("\n,", ",", 1)


@query
def library_clusters(spark, d):
    """The clusters of all faces, in one order, as one library."""
    found, _ = clusters_of_all.library_clusters(src.faces(spark, d).drop("person_id"), freshness.folder(spark, "library"), 0.3)
    return found.withColumn("score", F.round("score", 5))


ORACLE_SQL["library_clusters"] = sql("faces", clusters(0.3).replace("img AS scope", "0 AS scope").replace("PARTITION BY img", "PARTITION BY 0") + " SELECT vec_id, cluster, size, round(score, 5) AS score FROM clustered WHERE vec_id IS NOT NULL").replace("\n,", ",", 1)
