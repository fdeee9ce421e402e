"""What operators store: it lies in the shared folder, goes with a scope, and needs no setting under a local master."""

import os
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from tessera.llm.queries import QUERIES
from tessera.sources.places import scope

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def names(place):
    return sorted(p.name for p in Path(place.removeprefix("file:")).iterdir())


def test_the_pipeline_leaves_its_stages_alone(spark):
    """Inside a caller's scope: four tables of documents and what packing reads from; after it nothing."""
    before = spark.conf.get(BATCH)
    with scope(spark) as own:
        rows = corpus_pipeline.run(spark, SF).count()
        left = names(own)
        assert rows and sum(n.startswith("pipeline-") for n in left) == 4
        assert not any(n.startswith("scope-") for n in left)
    assert not Path(own.removeprefix("file:")).exists()
    assert spark.conf.get(BATCH) == before


def test_a_query_in_a_scope_gives_the_same_rows(spark):
    plain = sorted(QUERIES["op11_mixing"](spark, SF).collect())
    with scope(spark):
        assert sorted(QUERIES["op11_mixing"](spark, SF).collect()) == plain


UNSET = f"""
from pyspark.sql import SparkSession
from tessera.llm.queries import QUERIES
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
for name in ("op7_sharding", "op11_mixing", "op12_centroids", "op13_hard_negatives"):
    print("found", name, QUERIES[name](spark, {SF!r}).count() > 0)
"""


def test_queries_without_the_setting(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", UNSET], env=env, capture_output=True, text=True, timeout=400)
    assert done.stdout.count("True") == 4, done.stderr[-2000:]
