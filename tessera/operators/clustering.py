"""Identity clusters: online assignment within scopes, merge, split, reconcile, rename.

Assignment in one order is sequential, so here it runs within scopes (an owner, an album, an image group): each scope is a
group of its own, in the order of record and face index. ``library_clusters`` takes a whole library, in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import trimmed
from tessera.operators.vectors import mean_vectors, normalized


MOST_FACES = 200_000


def online_clusters(faces: DataFrame, scope: str, threshold: float = 0.45, roster: DataFrame | None = None, most: int = MOST_FACES) -> DataFrame:
    """scope, vec_id, cluster, size and score at assignment (null for a founder) of the faces that have no person yet.

    A face joins the centroid of largest inner product if that is at least ``threshold``, of equals the newest;
    the centroid becomes the normalised running mean in 32-bit floats. Centroids of another length don't count. ``roster``
    (the scope's column, person_id, face_count, centroid) is where a scope starts from: its people are clusters
    0, 1, ... in the order of person_id; new clusters follow by creation. Faces whose ``person_id`` isn't null, null
    vectors and null ids take no part. A scope is folded in one task, so one of over ``MOST_FACES`` faces is an error.
    """

    def assign(key: tuple, frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > most:
            raise ValueError(f"scope {key[0]!r} has {len(frame)} faces, over {most}: take library_clusters")
        held: dict[int, np.ndarray] = {}  # by length: the centroids, in the order of their numbers
        numbers: dict[int, list[int]] = {}
        sizes: list[int] = []
        out = []

        def seed(v: np.ndarray, size: int) -> None:
            n, block = len(numbers.setdefault(len(v), [])), held.setdefault(len(v), np.zeros((8, len(v)), np.float32))
            if n == len(block):
                held[len(v)] = block = np.concatenate([block, np.zeros_like(block)])
            block[n] = v
            numbers[len(v)].append(len(sizes))
            sizes.append(size)

        for row in known.sort_values("person_id").itertuples(index=False):
            seed(np.asarray(row.centroid, np.float32), int(row.face_count))
        for row in frame.sort_values(["record_id", "face_index", "vec_id"], kind="stable").itertuples(index=False):
            v = np.asarray(row.embedding, np.float32)
            own = numbers.get(len(v), [])
            scores = held[len(v)][: len(own)].astype(np.float64) @ v.astype(np.float64) if own else np.zeros(0)
            best = len(scores) - 1 - int(np.argmax(scores[::-1])) if len(scores) else -1
            if best >= 0 and scores[best] >= threshold:
                centroid, number = held[len(v)][best], own[best]
                mean = ((centroid.astype(np.float64) * sizes[number] + v) / (sizes[number] + 1)).astype(np.float32)
                length = float(np.sqrt((mean.astype(np.float64) ** 2).sum()))
                held[len(v)][best] = mean.astype(np.float64) / length if length else mean
                sizes[number] += 1
                out.append((key[0], row.vec_id, number, sizes[number], float(scores[best])))
            else:
                out.append((key[0], row.vec_id, len(sizes), 1, None))
                seed(v, 1)
        return pd.DataFrame(out, columns=["scope", "vec_id", "cluster", "size", "score"])

    free = faces.where("person_id is null") if "person_id" in faces.columns else faces
    rows = free.where("embedding is not null and vec_id is not null").select(F.col(scope).alias("scope"), "record_id", "face_index", "vec_id", "embedding")
    kind = rows.schema["scope"].dataType.simpleString()
    if roster is None:
        start = faces.sparkSession.createDataFrame([], f"scope {kind}, person_id string, face_count long, centroid array<float>")
    else:
        start = roster.where("centroid is not null").select(F.col(scope).alias("scope"), "person_id", "face_count", F.col("centroid").cast("array<float>").alias("centroid"))
    return rows.groupBy("scope").cogroup(start.groupBy("scope")).applyInPandas(assign, f"scope {kind}, vec_id long, cluster long, size long, score double")


def reclustered(faces: DataFrame, scope: str, threshold: float) -> DataFrame:
    """All faces assigned anew, from no clusters at all."""
    return online_clusters(faces.drop("person_id"), scope, threshold)


def reconciled(people: DataFrame, faces: DataFrame) -> DataFrame:
    """People that still have faces, with their recounted size and mean; ids and names stay."""
    counted = faces.groupBy("person_id").agg(F.count("*").alias("face_count"))
    means = mean_vectors(faces, "person_id").select("person_id", "centroid")
    return people.join(counted, "person_id").join(means, "person_id", "left").select("person_id", "name", "face_count", "centroid")


def merged(people: DataFrame, target: str, sources: list[str]) -> DataFrame:
    """People after sources went into the target: centroids weighted by size, sizes summed, its name or else the first
    source's (by id) that has one. Unknown sources are left out; an unknown target changes nothing."""
    known = people.where(F.col("person_id") == target).select(F.lit(True).alias("known"))  # one row at most
    inside = F.col("person_id").isin([target, *sources])
    some = people.where(inside)
    weight = F.greatest(F.lit(1), F.col("face_count"))
    sums = some.select(F.posexplode("centroid").alias("pos", "x"), weight.alias("w")).groupBy("pos").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("x"))
    centroid = sums.agg(normalized(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])).alias("centroid"))
    order = F.struct(F.col("person_id") != target, "person_id")
    named = F.when(trimmed(F.col("name")) != "", F.struct(order.alias("o"), "name"))
    one = some.agg(F.lit(target).alias("person_id"), F.coalesce(F.min(named)["name"], F.lit("")).alias("name"), F.sum(F.greatest(F.lit(0), F.col("face_count"))).alias("face_count"))
    whole = one.crossJoin(centroid).crossJoin(known).select("person_id", "name", "face_count", "centroid")  # one row each
    rest = people.join(F.broadcast(known), F.lit(True), "left").where(~inside | F.col("known").isNull())
    return rest.select("person_id", "name", "face_count", "centroid").unionByName(whole)


def repointed(faces: DataFrame, target: str, sources: list[str]) -> DataFrame:
    """faces with those of the sources given to the target."""
    return faces.withColumn("person_id", F.when(F.col("person_id").isin(sources), target).otherwise(F.col("person_id")))


def merged_with_faces(people: DataFrame, faces: DataFrame, target: str, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """People and faces after sources went into the target; both as they were if the target is unknown."""
    known = people.where(F.col("person_id") == target).select(F.lit(True).alias("_known"))  # one row at most
    moved = F.col("_known").isNotNull() & F.col("person_id").isin(sources)
    after = faces.join(F.broadcast(known), F.lit(True), "left").withColumn("person_id", F.when(moved, target).otherwise(F.col("person_id"))).drop("_known")
    return merged(people, target, sources), after


def split_off(people: DataFrame, faces: DataFrame, moved: DataFrame, new_id: str) -> tuple[DataFrame, DataFrame]:
    """People and faces after ``moved`` (record_id, face_index; each counts once) went to a new person.

    The new centroid is the mean of what moved; sources lose their count, not less than 0, and go when empty;
    their centroids stay. Faces without a vector don't move.
    """
    wanted = moved.select("record_id", "face_index").distinct().withColumn("moved", F.lit(True))
    marked = faces.join(wanted, ["record_id", "face_index"], "left").withColumn("moved", F.col("moved").isNotNull() & F.col("embedding").isNotNull())
    after = marked.withColumn("person_id", F.when(F.col("moved"), new_id).otherwise(F.col("person_id"))).select(*faces.columns)
    lost = marked.where("moved").groupBy("person_id").agg(F.count("*").alias("lost"))
    rest = people.join(lost, "person_id", "left").withColumn("face_count", F.greatest(F.lit(0).cast("long"), F.col("face_count") - F.coalesce("lost", F.lit(0)))).where("lost is null or face_count > 0").select(*people.columns)
    fresh = mean_vectors(after.where(F.col("person_id") == new_id), "person_id").select("person_id", F.lit("").alias("name"), F.col("n").alias("face_count"), "centroid")
    return rest.unionByName(fresh), after


def renamed(people: DataFrame, person_id: str, name: str) -> DataFrame:
    return people.withColumn("name", F.when(F.col("person_id") == person_id, trimmed(F.lit(name))).otherwise(F.col("name")))


def members(people: DataFrame, faces: DataFrame, extra: list[Column] = []) -> DataFrame:
    """People with the number of their faces, also those without any; most faces first, then the older."""
    counted = faces.groupBy("person_id").agg(F.count("*").alias("faces"), F.countDistinct("record_id").alias("records"))
    return people.join(counted, "person_id", "left").select("person_id", "name", "created_at", *extra, F.coalesce("faces", F.lit(0)).alias("faces"), F.coalesce("records", F.lit(0)).alias("records")).orderBy(F.desc("faces"), "created_at", "person_id")
