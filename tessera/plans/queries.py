"""The registered queries of the media catalog: operators composed over the adapted tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as fn
from tessera.operators import catalog, clustering, detection, gallery, publish, store, upsert, vectors
from tessera.sources import adapters as src
from tessera.sources import sidecars as files
from tessera.streaming import freshness

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
APP = src.APP


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def images(spark: SparkSession, d: str) -> DataFrame:
    return catalog.assembled(src.records(spark, d), src.metadata(spark, d), src.enriched(spark, d))


def scan_set(spark: SparkSession, d: str) -> DataFrame:
    return catalog.originals(src.records(spark, d), src.labels(spark, d), APP)


def kinds(spark: SparkSession, d: str) -> DataFrame:
    return catalog.derived_kind(src.records(spark, d), src.labels(spark, d), APP)


def roster(spark: SparkSession, d: str) -> DataFrame:
    """People with their centroid and size."""
    means = vectors.mean_vectors(src.faces(spark, d), "person_id").select("person_id", F.col("n").alias("face_count"), "centroid")
    return src.people(spark, d).join(means, "person_id").select("person_id", "name", "face_count", "centroid")


def spelt(people: DataFrame, *columns: str) -> DataFrame:
    """People with a row for each component of their centroids."""
    return people.select(*columns, F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 5))


TILE = ("id", "parent_id", "effective_date", "width", "height")


@query
def display_list(spark, d):
    return gallery.display_list(images(spark, d)).select(*TILE)


@query
def display_list_typed(spark, d):
    return gallery.display_list_typed(images(spark, d), src.labels(spark, d), APP).select(*TILE)


@query
def timeline_by_day(spark, d):
    return gallery.by_day(gallery.display_list(images(spark, d)))


@query
def scan_set_originals(spark, d):
    return scan_set(spark, d).select("id")


@query
def derived_kind(spark, d):
    return kinds(spark, d).select("id", "kind")


@query
def label_presence(spark, d):
    return catalog.having_label(src.records(spark, d), src.labels(spark, d), APP, "crop").select("id")


@query
def label_value_match(spark, d):
    return catalog.having_label(src.records(spark, d), src.labels(spark, d), "curation", "quality", "1").select("id")


@query
def label_rendered(spark, d):
    return src.labels(spark, d).select("record_id", catalog.rendered().alias("label"), "value")


@query
def records_with_labels(spark, d):
    shown = F.array_join(F.transform("labels", lambda x: F.concat(x["app_id"], F.lit("/"), x["key"], F.lit("="), x["value"])), ",")
    return catalog.with_labels(src.records(spark, d), src.labels(spark, d)).select("id", F.size("labels").cast("long").alias("n_labels"), shown.alias("labels"))


@query
def assembled_records(spark, d):
    return images(spark, d)


@query
def point_lookup(spark, d):
    return images(spark, d).where(F.col("id") == "rec-00000056")


@query
def catalog_page(spark, d):
    return catalog.page(src.records(spark, d), "rec-00000050", 100).select("id", "created_at")


@query
def changes_since_cursor(spark, d):
    return catalog.changed_since(src.records(spark, d), "2024-01-20T00:00:00").select("id", "created_at")


@query
def max_cursor(spark, d):
    return src.records(spark, d).agg(F.max("created_at").alias("cursor"))


@query
def types_granted(spark, d):
    granted = spark.createDataFrame([(t,) for t in sorted(set(fn.TYPE_BY_EXTENSION.values()))], "type string")
    return catalog.of_types(src.records(spark, d), granted).select("id", "type")


@query
def child_to_parent(spark, d):
    return catalog.shown_original(src.records(spark, d), src.records(spark, d).select("id", "parent_id"))


@query
def can_thumbnail(spark, d):
    asked = src.records(spark, d).select("id").unionByName(spark.createDataFrame([("rec-x",)], "id string"))
    return catalog.can_thumbnail(src.records(spark, d), asked, src.labels(spark, d), APP)


@query
def thumbnail_lookup(spark, d):
    return catalog.thumbnail_of(src.records(spark, d), src.labels(spark, d), APP)


@query
def url_batches(spark, d):
    asked = src.faces(spark, d).select(F.col("record_id").alias("id"))
    return catalog.lookup_batches(asked, src.records(spark, d))


@query
def pending_scan(spark, d):
    return store.pending(scan_set(spark, d), src.faces(spark, d)).select("id")


@query
def orphan_sidecars(spark, d):
    return store.orphans(scan_set(spark, d), src.faces(spark, d))


@query
def store_status(spark, d):
    return store.status(src.faces(spark, d), src.people(spark, d))


@query
def pass_counts(spark, d):
    return store.pass_counts(scan_set(spark, d), src.faces(spark, d))


@query
def untiled_originals(spark, d):
    sent = src.records(spark, d).where("doc_id % 3 = 0").select("id")
    return gallery.without_thumbnail(images(spark, d), sent)


@query
def toggled_selection(spark, d):
    chosen = src.records(spark, d).where("doc_id % 6 = 0").select("id")
    clicks = src.records(spark, d).where("doc_id % 4 = 0").select("id")
    return gallery.toggled(chosen, clicks)


@query
def content_dedup(spark, d):
    return upsert.content_inserts(src.records(spark, d))


@query
def upsert_merge(spark, d):
    feed = src.changes(spark, d)
    order = [F.desc("ts"), F.desc("event_id")]
    old = upsert.latest(feed.where("event_id % 2 = 0"), "id", order)
    return upsert.upserted(old, upsert.latest(feed.where("event_id % 2 = 1"), "id", order), "id").select("id", "event_id", "event_type")


def patches(spark: SparkSession, d: str) -> DataFrame:
    """Changes of enrichment, some of them too long or to the empty text."""
    k = F.col("doc_id")
    return src.table(spark, d, "documents").where(k % 7 == 0).select(src.rid("doc_id").alias("record_id"), F.when(k % 11 == 0, F.repeat(F.lit("x"), (F.lit(2000) + k % 2).cast("int"))).when(k % 2 == 0, F.concat(F.lit("new "), k.cast("string"))).otherwise("").alias("caption"), (k % 3 != 0).alias("has_caption"), F.lit(None).cast("string").alias("date_taken_override"), (k % 5 == 0).alias("has_date_taken_override"))


@query
def partial_upsert(spark, d):
    return upsert.patched(src.enriched(spark, d), patches(spark, d), "record_id", ["caption", "date_taken_override"])


@query
def label_add(spark, d):
    return upsert.labels_added(src.labels(spark, d), src.labels(spark, d).where("app_id = 'other'").withColumn("app_id", F.lit(APP)))


@query
def thumbnail_plan(spark, d):
    return upsert.thumbnails_due(kinds(spark, d))


@query
def metadata_writes(spark, d):
    return upsert.metadata_writes(src.metadata(spark, d), ["captured_at", "orientation"])


@query
def metadata_backfill(spark, d):
    return images(spark, d).where("width = 0").select("id")


@query
def delete_records(spark, d):
    return upsert.deleted(src.records(spark, d), scan_set(spark, d)).select("id")


@query
def app_row(spark, d):
    return catalog.app_row(src.enriched(spark, d), "rec-00000056")


def app_image_rows(spark: SparkSession, d: str) -> DataFrame:
    return catalog.app_images(src.listed(spark, d), src.labels(spark, d), src.metadata(spark, d), src.camera(spark, d), src.enriched(spark, d), APP)


@query
def app_images(spark, d):
    return app_image_rows(spark, d).select("*", "exif.*").drop("exif")


@query
def info_panel(spark, d):
    return catalog.info_panel(app_image_rows(spark, d))


@query
def requested_urls(spark, d):
    return catalog.requested(src.records(spark, d), src.faces(spark, d).select(F.col("record_id").alias("id"))).select("id", fn.content_key(F.col("type"), F.col("content_hash")).alias("object_key"))


@query
def crop_records(spark, d):
    return upsert.crop_records(src.faces(spark, d), F.lit(640).cast("long"), F.lit(420).cast("long"), APP)


@query
def slot_guards(spark, d):
    k = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("image/png", "image/svg+xml", "image/gif; q=1", "text/x", "", " image/webp "))), (k % 6 + 1).cast("int"))
    slot = F.when(k % 4 < 2, "cover").otherwise("style-graphic")
    return src.records(spark, d).select("id", slot.alias("slot"), fn.slot_refusal(slot, F.when(k % 9 == 0, 0).otherwise(k * 25_000), kind).alias("refused"))


@query
def sidecar_reads(spark, d):
    read = files.parsed(src.sidecar_bodies(spark, d))
    return read.select("record_id", "v", "model", F.size("faces").cast("long").alias("n_faces"), store.is_current(F.col("v"), F.col("model")).alias("current"))


@query
def sidecar_status(spark, d):
    return store.files_status(files.parsed(src.sidecar_bodies(spark, d)))


@query
def sidecar_pending(spark, d):
    return store.pending_files(scan_set(spark, d), files.parsed(src.sidecar_bodies(spark, d))).select("id")


@query
def sidecar_publish_plan(spark, d):
    done = files.parsed(src.sidecar_bodies(spark, d)).where(store.is_current(F.col("v"), F.col("model")))
    found = done.select("record_id", F.explode("faces").alias("f")).select("record_id", F.col("f.personId").alias("person_id"))
    return publish.publish_plan(found, src.people(spark, d), done).select("record_id", "key", F.array_join("values", "|").alias("shown"), F.size("values").cast("long").alias("n_values"))


def model_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Expected files and those on disk, some of them cut short or missing."""
    k = F.col("p_partkey")
    expected = src.table(spark, d, "part").select(F.concat(F.lit("model-"), k.cast("string")).alias("name"), F.col("p_size").cast("long").alias("size"), "p_partkey")
    return expected, expected.where(k % 15 != 0).withColumn("size", F.when(k % 10 == 0, F.col("size") - 1).otherwise(F.col("size")))


@query
def missing_models(spark, d):
    return store.missing_files(*model_files(spark, d)).select("name", "size")


@query
def model_totals(spark, d):
    expected, found = model_files(spark, d)
    return store.file_totals(expected, store.missing_files(expected, found))


@query
def verified_files(spark, d):
    k = F.col("doc_id")
    given = src.table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.sha2(F.when(k % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha256"))
    return store.verified(given).select("doc_id")


@query
def enabled_tasks(spark, d):
    tasks = src.table(spark, d, "region").select(F.col("r_name").alias("task"), "r_regionkey")
    return store.enabled_tasks(tasks, tasks.select("task", (F.col("r_regionkey") % 2 == 0).alias("enabled")))


@query
def manifest_keys(spark, d):
    k = F.col("doc_id")
    return store.key_differences(src.records(spark, d).where(k % 3 > 0).select(F.col("id").alias("key")), src.records(spark, d).where(k % 5 > 0).select(F.col("id").alias("key")))


@query
def isolated_failures(spark, d):
    k = F.col("doc_id")
    text = F.when(k % 8 == 0, F.concat(F.lit("bad "), F.col("created_at"))).otherwise(F.substring("created_at", 1, 10))
    return store.isolated(src.records(spark, d).select("id", text.alias("text")), F.try_to_date("text", "yyyy-MM-dd"), "day").select("id", "day", "failed")


@query
def exif_coercion(spark, d):
    k = F.col("event_id")
    text = F.when(k % 4 == 0, "").when(k % 4 == 1, F.col("event_type"))
    number = F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 5 == 1, F.lit(float("-inf"))).when(k % 5 > 2, F.col("value"))
    return src.changes(spark, d).select("event_id", fn.text_or_null(text).alias("make"), fn.number_or_null(number).alias("iso"))


@query
def version_checks(spark, d):
    k = F.col("p_partkey")
    version = F.concat((k % 3).cast("string"), F.lit("."), (k % 13).cast("string"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("."), (k % 5).cast("string"))), F.when(k % 6 == 0, "-rc.9").otherwise(""))
    given = F.element_at(F.array(*map(F.lit, ("^1.2.3", ">= 1.10.0", "1.2.2", "latest", " ~2.0.1 "))), (k % 5 + 1).cast("int"))
    floor = fn.range_floor(given)
    return src.table(spark, d, "part").select("p_partkey", floor.alias("floor"), F.when(floor.isNotNull(), fn.version_struct(version) < fn.version_struct(floor)).alias("older"))


@query
def merged_config(spark, d):
    k = F.col("event_id")
    patch = F.element_at(F.array(*map(F.lit, (
        '{"faces":{"enabled":false,"threshold":0.5}}', '{"faces":{"enabled":"no","threshold":2,"publishLabels":true}}', '{"faces":{"threshold":"0.5","publishLabels":1}}', '{"faces":[1]}', "{}", "oops", '{"faces":{"threshold":-1e300,"enabled":null}}',
    ))), (k % 7 + 1).cast("int"))
    return src.changes(spark, d).select("event_id", *[c.alias(n) for n, c in fn.merged_config(patch, {"enabled": True, "threshold": 0.45, "publish": False}).items()])


def plan(spark: SparkSession, d: str) -> DataFrame:
    return publish.publish_plan(store.current(src.faces(spark, d)), src.people(spark, d))


@query
def publish_plan(spark, d):
    return plan(spark, d).select("record_id", "key", F.array_join("values", "|").alias("shown"), F.size("values").cast("long").alias("n_values"))


@query
def publish_batches(spark, d):
    return publish.batched(plan(spark, d), 20).select("record_id", "key", "batch")


@query
def publish_summary(spark, d):
    whole = plan(spark, d)
    return publish.publish_summary(whole, publish.batched(whole, 20))


@query
def retract_plan(spark, d):
    return publish.retract_plan(store.current(src.faces(spark, d))).select("record_id", "key", F.size("values").cast("long").alias("n_values"))


@query
def label_set_diff(spark, d):
    standing = src.faces(spark, d).where("vec_id % 3 = 0").select("record_id", F.lit("faceCount").alias("key"), F.lit("2").alias("value")).unionByName(src.faces(spark, d).where("vec_id % 5 = 0").select("record_id", F.lit("faces").alias("key"), F.lit("Old").alias("value")))
    return publish.set_difference(plan(spark, d), standing)


@query
def vector_matches_over_threshold(spark, d):
    found = vectors.matches_over(src.table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, 0.3)
    return found.withColumn("score", F.round("score", 6))


@query
def vector_best_match(spark, d):
    found = vectors.best_match(src.faces(spark, d).where("v = 1"), roster(spark, d), 0.1)
    return found.withColumn("score", F.round("score", 5))


@query
def vector_norms(spark, d):
    unit = F.posexplode(vectors.normalized(F.col("embedding"))).alias("pos", "x")
    return src.table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), unit).withColumn("x", F.round("x", 6))


@query
def centroid_by_label(spark, d):
    means = vectors.mean_vectors(src.faces(spark, d), "person_id")
    return means.select("person_id", "n", F.posexplode("centroid").alias("pos", "x")).select("person_id", "n", "pos", F.round("x", 5).alias("x"))


@query
def base64_roundtrip(spark, d):
    wires = vectors.encode_base64(src.table(spark, d, "embeddings"))
    cut = F.when(F.col("vec_id") % 50 == 0, F.lit("AAAA")).when(F.col("vec_id") % 50 == 1, F.lit("?")).otherwise(F.col("wire"))  # three bytes, and no base64
    back = vectors.decode_base64(wires.withColumn("wire", cut))
    return back.select("vec_id", F.posexplode_outer("embedding").alias("pos", "x"))


@query
def online_clusters(spark, d):
    return clustering.online_clusters(src.faces(spark, d).drop("person_id"), "img", 0.3).withColumn("score", F.round("score", 5))


@query
def people_ranked(spark, d):
    return clustering.members(src.people(spark, d), src.faces(spark, d))


@query
def faces_top_k(spark, d):
    top = vectors.top_by(src.faces(spark, d), "person_id", [F.desc("score"), F.asc("vec_id")], 60)
    return top.select("person_id", "vec_id", "score", "rank")


@query
def face_projection(spark, d):
    named = src.faces(spark, d).join(src.people(spark, d), "person_id", "left")
    return named.select("record_id", "face_index", "x", "y", "w", "h", "score", "person_id", F.coalesce("name", F.lit("")).alias("name"))


@query
def merge_people(spark, d):
    done = clustering.merged(roster(spark, d), "1", ["2", "5", "none"])
    return spelt(done, "person_id", "name", "face_count")


@query
def split_people(spark, d):
    gone = src.faces(spark, d).where("vec_id % 4 = 0").select("record_id", "face_index")
    people, _ = clustering.split_off(roster(spark, d), src.faces(spark, d), gone, "new")
    return spelt(people, "person_id", "face_count")


def pixel(x: Column) -> Column:
    """A component of a vector as a byte."""
    return F.pmod(F.floor(x.cast("double") * 1000), F.lit(256))


@query
def warped_crops(spark, d):
    """Every vector's first 60 components as an image of 5 by 4 pixels, warped."""
    digits = F.transform(F.slice("embedding", 1, 60), lambda x: F.lpad(F.hex(pixel(x)), 2, "0"))
    t = F.struct(*[F.lit(v).alias(n) for n, v in (("a", 0.5), ("b", 0.1), ("c", -0.1), ("d", 0.5), ("tx", 0.3), ("ty", 0.2))])
    images = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(5).alias("width"), F.lit(4).alias("height"), F.unhex(F.array_join(digits, "")).alias("rgb"), t.alias("t"))
    return detection.warped(images, 4).select("id", F.hex("crop").alias("crop"))


@query
def split_faces(spark, d):
    gone = src.faces(spark, d).where("vec_id % 4 = 0").select("record_id", "face_index")
    _, faces = clustering.split_off(roster(spark, d), src.faces(spark, d), gone, "new")
    return faces.select("vec_id", "person_id")


@query
def merge_people_faces(spark, d):
    _, faces = clustering.merged_with_faces(roster(spark, d), src.faces(spark, d), "1", ["2", "5", "none"])
    return faces.select("vec_id", "person_id")


@query
def recluster_all(spark, d):
    found = clustering.reclustered(src.faces(spark, d), "img", 0.2)
    return found.groupBy("scope").agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("clusters"))


@query
def reconcile_people(spark, d):
    kept = src.faces(spark, d).where("person_id <> '3' and v = 1")
    return spelt(clustering.reconciled(src.people(spark, d), kept), "person_id", "face_count")


@query
def rename_person(spark, d):
    return clustering.renamed(src.people(spark, d), "3", "  Ann ").select("person_id", "name")


def raw_boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("vec_id")
    stride = F.element_at(F.array(*map(F.lit, detection.STRIDES)), (k % 3 + 1).cast("int"))
    distances = [(k % n / 2).cast("double").alias(c) for c, n in (("l", 5), ("t", 7), ("r", 3), ("b", 4))]
    kps = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((k + i) % 9 - 4) / 4.0)
    return src.faces(spark, d).select("img", "vec_id", stride.alias("stride"), (k * 7 % 800).alias("anchor"), "score", *distances, kps.alias("kps"))


@query
def anchor_grid(spark, d):
    """Every anchor of the detector, with the number of raw boxes that are at it."""
    at = raw_boxes(spark, d).where("score >= 0.6").groupBy("stride", "anchor").agg(F.count("*").alias("n"))
    return detection.anchor_grid(spark).join(at, ["stride", "anchor"], "left").select("stride", "anchor", "cx", "cy", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query
def decode_boxes(spark, d):
    found = detection.decode_boxes(raw_boxes(spark, d), detection.anchor_grid(spark), 0.6)
    return found.select("img", "stride", "anchor", "score", "x1", "y1", "x2", "y2", F.array_join(F.transform("landmarks", lambda x: x.cast("int").cast("string")), ",").alias("landmarks"))


@query
def detect_faces(spark, d):
    return detection.detections(raw_boxes(spark, d), detection.anchor_grid(spark), 0.6, 0.1)


def tensors(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of a detector for each document: three kinds at three strides, some with a leading 1."""
    k, shape = F.col("doc_id"), F.explode(F.array(*[F.struct(F.lit(2 * (640 // s) ** 2).alias("rows"), F.lit(w).alias("wide")) for s in (32, 8, 16) for w in (10, 1, 4)]))
    made = src.table(spark, d, "documents").select(k.alias("img"), shape.alias("s"))
    dims = F.when(F.col("img") % 2 == 0, F.array("s.rows", "s.wide")).otherwise(F.array(F.lit(1), F.col("s.rows"), F.col("s.wide")))
    return made.select("img", (F.col("s.rows") * 100 + F.col("s.wide")).cast("long").alias("tensor_id"), dims.alias("dims"))


@query
def tensor_kinds(spark, d):
    odd = src.table(spark, d, "documents").select(F.col("doc_id").alias("img"), F.lit(0).cast("long").alias("tensor_id"), F.array(F.lit(77), F.lit(3)).alias("dims"))
    known = detection.tensor_kind(F.col("dims"))
    return tensors(spark, d).unionByName(odd).select("img", "tensor_id", known["kind"].alias("kind"), known["stride"].alias("stride"))


@query
def grouped_heads(spark, d):
    return detection.grouped_heads(tensors(spark, d))


@query
def unletterboxed(spark, d):
    boxes = detection.decode_boxes(raw_boxes(spark, d), detection.anchor_grid(spark), 0.6)
    wide = F.col("vec_id") % 5 * 100 + 640
    back = detection.unletterboxed(boxes, fn.letterbox_scale(wide, F.lit(480)))
    return back.select("vec_id", *[F.round(c, 6).alias(c) for c in "xywh"])


@query
def template_fit(spark, d):
    k = F.col("vec_id")
    upright = F.transform(F.array(*[F.lit(v) for point in detection.TEMPLATE for v in point]), lambda v, i: v * (k % 3 + 1) + F.when(i % 2 == 0, k % 7).otherwise(k % 5))
    marks = src.faces(spark, d).select("vec_id", upright.alias("landmarks"))
    return detection.template_fit(marks, "vec_id").select("vec_id", "n", *[F.round(c, 5).alias(c) for c in ("a", "b", "c", "d", "tx", "ty")])


@query
def pixel_planes(spark, d):
    pixels = F.transform(F.slice("embedding", 1, 12), lambda x: pixel(x).cast("double"))
    return src.table(spark, d, "embeddings").select("vec_id", F.posexplode(detection.planes(pixels, 127.5, 128.0)).alias("pos", "x"))


@query
def iou_pairs(spark, d):
    return detection.overlapping_pairs(src.faces(spark, d), 0.1).withColumn("iou", F.round("iou", 6))


@query
def nms_keep(spark, d):
    return detection.suppressed(src.faces(spark, d), 0.1)


@query
def umeyama_fit(spark, d):
    k = F.col("vec_id")
    points = src.faces(spark, d).select("img", "x", "y", (F.col("x") * 0.5 - F.col("y") * 0.25 + k % 3).alias("dx"), (F.col("x") * 0.25 + F.col("y") * 0.5 + k % 2).alias("dy")).withColumnsRenamed({"x": "sx", "y": "sy"})
    return detection.similarity_fit(points, "img").select("img", "n", *[F.round(c, 5).alias(c) for c in ("a", "b", "c", "d", "tx", "ty")])


@query
def affine_roundtrip(spark, d):
    t = F.struct(*[F.lit(v).alias(n) for n, v in (("a", 2.0), ("b", -0.5), ("c", 0.5), ("d", 2.0), ("tx", 3.0), ("ty", -1.0))])
    both = src.faces(spark, d).select("vec_id", "x", "y", t.alias("t")).withColumn("i", detection.inverted(F.col("t")))
    u, v = detection.applied(F.col("i"), F.col("x"), F.col("y"))
    x, y = detection.applied(F.col("i"), *detection.applied(F.col("t"), F.col("x"), F.col("y")))
    return both.select("vec_id", *[F.round(c, 6).alias(n) for n, c in (("u", u), ("v", v), ("x", x), ("y", y))])


@query
def crop_rects(spark, d):
    r = fn.crop_rectangle(*[F.col(c) for c in "xywh"], F.lit(640).cast("long"), F.lit(420).cast("long"))
    return src.faces(spark, d).select("vec_id", *[c.alias(n) for n, c in r.items()])


@query
def percent_boxes(spark, d):
    return src.faces(spark, d).select("vec_id", *[F.round(F.col(c) / side * 100, 6).alias(c) for c, side in (("x", 640), ("y", 480), ("w", 640), ("h", 480))])


@query
def display_dims(spark, d):
    w, h, ratio = fn.shown_size(F.col("width"), F.col("height"), F.col("orientation"))
    sw, sh = fn.downsized(F.col("width"), F.col("height"), 1024)
    return images(spark, d).select("id", w.alias("w"), h.alias("h"), F.round(ratio, 6).alias("ratio"), sw.alias("small_w"), sh.alias("small_h"), F.round(fn.letterbox_scale(F.col("width"), F.col("height")), 6).alias("scale"))


@query
def exif_dates(spark, d):
    k, t = F.col("doc_id"), F.col("created_at")
    raw = F.concat(F.translate(F.substring(t, 1, 10), "-", ":"), F.when(k % 4 == 0, "T").otherwise(" "), F.substring(t, 12, 8))
    return src.records(spark, d).select("id", fn.exif_date(F.when(k % 9 == 0, F.concat(raw, F.lit("Z"))).otherwise(raw)).alias("taken"))


@query
def exposure_text(spark, d):
    k = F.col("doc_id")
    return src.records(spark, d).select("id", fn.exposure_text(F.when(k % 3 == 0, (k % 5).cast("double")).otherwise(1.0 / (k % 500 + 2))).alias("exposure"))


@query
def file_types(spark, d):
    name = F.col("filename")
    return src.records(spark, d).select("id", fn.extension(name).alias("extension"), fn.type_from_filename(name).alias("by_name"), fn.upload_type(name, F.when(F.col("doc_id") % 2 == 0, "text/x").otherwise("")).alias("upload"))


@query
def info_texts(spark, d):
    return images(spark, d).select("id", fn.bytes_text(F.col("size_bytes") * 1000).alias("size"), fn.megapixels_text(F.col("width"), F.col("height")).alias("pixels"), fn.orientation_text(F.col("orientation")).alias("orientation"))


@query
def retry_envelope(spark, d):
    """The changes of a user as attempts, one after another: the longest wait, whether a code is tried again, the progress to the largest value."""
    attempt = F.row_number().over(Window.partitionBy("id").orderBy("ts", "event_id")) - 1
    most = F.max("value").over(Window.partitionBy("id"))
    return src.changes(spark, d).select("event_id", fn.retry_ceiling_ms(attempt).alias("most_ms"), fn.retryable(F.lit(427) + F.col("event_id") % 8).alias("again"), fn.progress_percent(F.floor("value"), F.floor(most)).alias("percent"))


@query
def threshold_clamp(spark, d):
    return src.changes(spark, d).select("event_id", fn.clamped_threshold(F.col("value") / 100, F.lit(0.45)).alias("threshold"))


@query
def freshness_snapshot(spark, d):
    feed = freshness.change_stream(spark, f"{d}/events.parquet").select(F.col("user_id").alias("id"), "event_id", "ts", "event_type", "value")
    return freshness.fresh_snapshot(feed, freshness.folder(spark, "fresh")).select("id", "event_id", "event_type")


@query
def events_by_hour(spark, d):
    return freshness.windowed_counts(src.changes(spark, d))


@query
def toggle_edges(spark, d):
    log = src.changes(spark, d).withColumn("flag", F.coalesce(F.col("event_id") % 3 > 0, F.lit(False)))
    return freshness.toggles(log, "id", "flag").select("id", "event_id", "action")
