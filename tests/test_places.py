"""The shared folder: found, made where none is set, and cleared by scopes."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.sources.places import folder, scope, shared_folder, written

ROOT = Path(__file__).resolve().parents[1]
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def local(place):
    return Path(place.removeprefix("file:"))


def stored(place):
    return sorted(p.name.split("-")[0] for p in local(place).iterdir())


def test_a_scope_clears_what_it_stored_and_keeps_the_rest(spark):
    kept = written(spark.range(10), "kept")
    with scope(spark) as own:
        assert shared_folder(spark) == own
        inside = written(spark.range(5).select(F.col("id") * 2), "inside")
        assert inside.count() == 5 and stored(own) == ["inside"]
    assert not local(own).exists() and shared_folder(spark) != own
    assert kept.count() == 10


def test_nested_scopes_end_one_by_one(spark):
    with scope(spark) as outer:
        first = written(spark.range(3), "first")
        with scope(spark) as inner:
            assert inner.startswith(f"{outer}/")
            written(spark.range(4), "second")
        assert stored(outer) == ["first"] and first.count() == 3
    assert not local(outer).exists()


def test_a_scope_ends_after_an_error(spark):
    before = shared_folder(spark)
    with pytest.raises(ZeroDivisionError), scope(spark) as own:
        written(spark.range(3), "lost")
        1 / 0  # noqa: B018
    assert not local(own).exists() and shared_folder(spark) == before


def test_settings_come_back(spark):
    before = spark.conf.get(BATCH)
    new = "spark.tessera.added"
    with scope(spark):
        spark.conf.set(BATCH, "12345")
        spark.conf.set(new, "1")
    assert spark.conf.get(BATCH) == before and spark.conf.get(new, None) is None


def test_places_differ(spark):
    assert folder(spark, "x") != folder(spark, "x")


UNSET = """
from pyspark.sql import SparkSession
from tessera.sources import places
spark = SparkSession.builder.master("{master}").config("spark.ui.enabled", "false").getOrCreate()
try:
    one = places.shared_folder(spark)
    with places.scope(spark):
        n = places.written(spark.range(7), "t").count()
    print("found", n, one == places.shared_folder(spark), one.startswith("file:///"))
except ValueError as refused:
    print("refused", refused)
"""


@pytest.mark.parametrize(("master", "says"), [("local[1]", "found 7 True True"), ("local-cluster[1,1,1024]", "refused spark.checkpoint.dir has to name")])
def test_without_the_setting(tmp_path, master, says):
    """A local master gets a folder of its own, a cluster refuses. In a process of its own, with no defaults of the machine."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", UNSET.format(master=master)], env=env, capture_output=True, text=True, timeout=240)
    assert says in done.stdout, done.stderr[-2000:]
