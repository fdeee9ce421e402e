"""Clusters of a whole library in blocks against the fold over one face after another."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.clustering import online_clusters
from tessera.operators.library_clusters import library_clusters

FACES = "vec_id long, record_id string, face_index int, embedding array<float>"


def library(n, groups, spread, seed=1, d=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, d))
    x = middle[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order = random.Random(seed)
    rows = [(k, f"rec-{order.randrange(n):05d}", k % 3, x[k].astype(np.float32).tolist()) for k in range(n)]
    return rows + [(n, "rec-00001", 0, None), (None, "rec-00002", 0, x[0].tolist()), (n + 1, "rec-00003", 0, [1.0, 0.0]), (n + 2, "rec-00004", 1, [0.9, 0.1])]


def fold(df, threshold):
    return {(r.vec_id, r.cluster, r.size, None if r.score is None else round(r.score, 9)) for r in online_clusters(df.withColumn("all", F.lit(0)), "all", threshold).collect()}


@pytest.mark.parametrize("spread, listed", [(0.3, 8), (0.8, 1), (0.8, 2)])
def test_blocks_equal_the_fold(spark, tmp_path, spread, listed):
    df = spark.createDataFrame(library(240, 12, spread), FACES).repartition(3)
    got, roster = library_clusters(df, f"file://{tmp_path}/library", 0.5, block=64, n=listed)
    rows = {(r.vec_id, r.cluster, r.size, None if r.score is None else round(r.score, 9)) for r in got.collect()}
    assert rows == fold(df, 0.5)
    sizes = {r.cluster: r.size for r in roster.read().collect()}
    assert sum(sizes.values()) == len(rows) == 242 and set(sizes) == {r[1] for r in rows}


def test_a_run_that_stops_goes_on(spark, tmp_path, monkeypatch):
    from tessera.streaming.versioned import VersionedTable

    df = spark.createDataFrame(library(150, 5, 0.5), FACES)
    commit, calls = VersionedTable.commit, []

    def dies(self, version):
        calls.append(version)
        if len(calls) == 3:
            raise OSError("killed")
        return commit(self, version)

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "commit", dies)
        with pytest.raises(OSError):
            library_clusters(df, f"file://{tmp_path}/library", 0.6, block=40)
    got, _ = library_clusters(df, f"file://{tmp_path}/library", 0.6, block=40)
    assert {(r.vec_id, r.cluster, r.size, None if r.score is None else round(r.score, 9)) for r in got.collect()} == fold(df, 0.6)


def test_an_empty_library(spark, tmp_path):
    got, roster = library_clusters(spark.createDataFrame([], FACES), f"file://{tmp_path}/library")
    assert got.count() == 0 and roster.read().count() == 0
