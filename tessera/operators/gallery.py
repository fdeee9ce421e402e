"""The gallery: one tile per original, newest first, and the days they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.catalog import derived_kind


def latest_child(children: DataFrame) -> DataFrame:
    """The newest child of each parent; of equally new ones the first by id."""
    newest = Window.partitionBy("parent_id").orderBy(F.desc("created_at"), "id")
    return children.where("parent_id is not null").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def display_list(images: DataFrame) -> DataFrame:
    """Tiles: the newest child of each parent, whatever its kind, and originals without a child; newest first, then by id.

    An original and its children are one group of a single window; children come first there.
    """
    order = Window.partitionBy(F.coalesce("parent_id", "id")).orderBy(F.col("parent_id").isNull(), F.desc("created_at"), "id")
    return images.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").orderBy(F.desc("effective_date"), "id")


def display_list_typed(images: DataFrame, labels: DataFrame, app: str) -> DataFrame:
    """As display_list, but only children labelled as thumbnails stand for their parents."""
    typed = derived_kind(images, labels, app)
    return display_list(typed.where("parent_id is null or kind = 'thumbnail'")).drop("kind")


def by_day(images: DataFrame) -> DataFrame:
    """day (first ten characters of the effective date) with the number and the first and last id; newest day first."""
    day = F.substring("effective_date", 1, 10).alias("day")
    return images.groupBy(day).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).orderBy(F.desc("day"))


def without_thumbnail(images: DataFrame, submitted: DataFrame) -> DataFrame:
    """Originals without a child that weren't submitted (id) for thumbnailing yet."""
    tiles = latest_child(images).select(F.col("parent_id").alias("id"))
    return images.where("parent_id is null").join(tiles, "id", "left_anti").join(submitted, "id", "left_anti").select("id")


def toggled(selected: DataFrame, clicks: DataFrame) -> DataFrame:
    """Ids selected after clicks, each of which adds or takes away its id."""
    both = selected.select("id").distinct().unionByName(clicks.select("id"))
    return both.groupBy("id").agg(F.count("*").alias("n")).where("n % 2 = 1").select("id")
