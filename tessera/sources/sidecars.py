"""Sidecar files: one JSON document for each record, with the faces found in it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACE = "struct<bbox:array<double>,score:double,kps:array<array<double>>,embedding:string,personId:string>"
SIDECAR = f"v int, model string, w int, h int, faces array<{FACE}>"
PEOPLE = "id string, name string, centroid string, faceCount long, createdAt string"


def parsed(bodies: DataFrame) -> DataFrame:
    """record_id, v, model, w, h, faces from bodies (record_id, body): those that can be read and hold an array of faces.

    A sidecar without any face has an empty array.
    """
    read = bodies.select("record_id", F.from_json("body", SIDECAR, {"mode": "PERMISSIVE"}).alias("s"))
    return read.select("record_id", "s.*").where("faces is not null")


def bodies(spark: SparkSession, folder: str) -> DataFrame:
    """record_id (the file's name without .json) and body of every sidecar in a folder; none if it isn't there."""
    try:
        files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "record_id string, body string")
    return files.select(F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.json$", "").alias("record_id"), F.col("value").alias("body"))


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """The readable sidecars of a folder."""
    return parsed(bodies(spark, folder))


def people(spark: SparkSession, path: str) -> DataFrame:
    """The roster, a JSON array in one file; empty if it is missing or can't be read."""
    try:
        rows = spark.read.text(path, wholetext=True)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PEOPLE)
    return rows.select(F.explode(F.from_json("value", f"array<struct<{', '.join(x.strip().replace(' ', ':') for x in PEOPLE.split(','))}>>")).alias("p")).select("p.*")
