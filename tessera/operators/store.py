"""The store of detections: current ones, what a scan has to do, orphans, counts, and the models it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions.scalars import trimmed
from tessera.operators.observed import counted

VERSION = 1
#: Fixed value: the pair of models that current detections come from.
MODEL = "antelopev2:scrfd_10g_bnkps+glintr100"


def current(faces: DataFrame, version: int = VERSION) -> DataFrame:
    """Detections of the current version."""
    return faces.where(F.col("v") == version)


def is_current(v: Column, model: Column) -> Column:
    """Is a stored record of the current version and of the current models?"""
    return F.coalesce((v == VERSION) & (model == MODEL), F.lit(False))


def pending(scan_set: DataFrame, faces: DataFrame) -> DataFrame:
    """Records of the scan set without current detections."""
    return scan_set.join(current(faces).select(F.col("record_id").alias("id")), "id", "left_anti")


def pending_files(scan_set: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Records of the scan set without a current sidecar; one that holds no faces counts as done."""
    done = sidecars.where(is_current(F.col("v"), F.col("model"))).select(F.col("record_id").alias("id"))
    return scan_set.join(done, "id", "left_anti")


def orphans(scan_set: DataFrame, faces: DataFrame) -> DataFrame:
    """Stored records that aren't in the scan set; none while the scan set is empty."""
    known = scan_set.agg(F.count("*").alias("known"))  # one row
    stored = faces.select("record_id").distinct()
    missing = stored.join(scan_set.select(F.col("id").alias("record_id")), "record_id", "left_anti")
    return missing.join(F.broadcast(known), F.col("known") > 0).select("record_id")


def status(faces: DataFrame, people: DataFrame) -> DataFrame:
    """Counts of the store, in one row."""
    stored = faces.agg(
        F.countDistinct("record_id").alias("stored"),
        F.countDistinct(F.when(F.col("v") == VERSION, F.col("record_id"))).alias("processed"),
        F.count_if(F.col("v") == VERSION).alias("faces"),
    )
    roster = people.agg(F.count("*").alias("people"), F.count_if(trimmed(F.col("name")) != "").alias("named_people"))
    return stored.crossJoin(roster).withColumn("stale", F.greatest(F.col("stored") - F.col("processed"), F.lit(0)))  # one row each


def files_status(sidecars: DataFrame) -> DataFrame:
    """Counts of sidecars (record_id, v, model, faces), in one row: on disk, processed, images with faces, faces."""
    own, n = is_current(F.col("v"), F.col("model")), F.size("faces")
    return sidecars.agg(F.count("*").alias("on_disk"), F.count_if(own).alias("processed"), F.count_if(own & (n > 0)).alias("images_with_faces"), F.coalesce(F.sum(F.when(own, n)), F.lit(0)).alias("faces"))


OUTCOMES = ("skipped", "stale", "new")


def with_outcome(scan_set: DataFrame, faces: DataFrame) -> DataFrame:
    """id and outcome of the scan set's records: skipped (current), stale or new."""
    stored = faces.groupBy(F.col("record_id").alias("id")).agg(F.max("v").alias("v"))
    outcome = F.when(F.col("v") == VERSION, "skipped").when(F.col("v").isNotNull(), "stale").otherwise("new")
    return scan_set.select("id").join(stored, "id", "left").select("id", outcome.alias("outcome"))


def pass_counts(scan_set: DataFrame, faces: DataFrame) -> DataFrame:
    """outcome and n: records of the scan set by outcome."""
    return with_outcome(scan_set, faces).groupBy("outcome").agg(F.count("*").alias("n"))


def planned_pass(scan_set: DataFrame, faces: DataFrame, place: str) -> dict[str, int]:
    """Write the records that a pass has to work on (id, outcome: stale or new) to a place, and count all outcomes on the way.

    The counters are observed while the rows pass by to be written, so nothing is read again for them.
    """
    seen, counts = Observation("pass"), [F.count("*").alias("eligible"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]]
    rows = with_outcome(scan_set, faces)
    rows.observe(seen, *counts).where("outcome <> 'skipped'").write.parquet(place)
    return counted(seen, rows, counts)


def missing_files(expected: DataFrame, found: DataFrame) -> DataFrame:
    """The expected files (name, size) that aren't found with exactly their size."""
    return expected.join(found.select("name", "size"), ["name", "size"], "left_anti")


def file_totals(expected: DataFrame, missing: DataFrame) -> DataFrame:
    """One row: bytes of all expected files, of the missing ones, how many are missing, and whether none is."""
    whole = expected.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))
    gone = missing.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("missing_bytes"), F.count("*").alias("n_missing"))
    return whole.crossJoin(gone).withColumn("installed", F.col("n_missing") == 0)  # one row each


def verified(files: DataFrame) -> DataFrame:
    """files (content, sha256 in lower-case hex) whose content has that digest."""
    return files.where(F.sha2("content", 256) == F.col("sha256"))


def enabled_tasks(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """tasks (task) that the configuration (task, enabled) asks for; none is an empty pass, not an error."""
    return tasks.join(wanted.where("enabled").select("task"), "task", "left_semi")


def key_differences(manifest: DataFrame, code: DataFrame) -> DataFrame:
    """Keys (column ``key``) that only one side has, and which."""
    only = lambda a, b, name: a.select("key").distinct().exceptAll(b.select("key").distinct()).withColumn("only_in", F.lit(name))
    return only(manifest, code, "manifest").unionByName(only(code, manifest, "code"))


def isolated(rows: DataFrame, made: Column, name: str) -> DataFrame:
    """rows with a computed column and ``failed``: a row whose value can't be made doesn't stop the others.

    ``made`` gives null for such a row (a ``try_`` function); failed rows aren't stored, so that the next pass tries them again.
    """
    return rows.withColumn(name, made).withColumn("failed", F.col(name).isNull())
