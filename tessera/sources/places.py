"""Places in the folder that the driver and all executors share, and tables that are written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"
#: The folder in use of each application: its own where none is set (Spark doesn't let a session set it), and the innermost scope's.
IN_USE: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the scope's inside it.

    Where it is unset, a local master gets one folder of its own; on a cluster that would be lost with a machine.
    """
    app = spark.sparkContext.applicationId
    if app in IN_USE:
        return IN_USE[app]
    shared = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    if shared:
        return shared.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError(f"{SHARED} has to name a folder that the driver and all executors share")
    IN_USE[app] = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    return IN_USE[app]


def folder(spark: SparkSession, what: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: it isn't computed twice, and lost executors don't matter."""
    place = folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """What is stored inside goes at the end, also after an error, and the session's settings are as before.

    Results are read from stored tables, so they have to be used (written elsewhere, counted) before the scope ends. Scopes
    may be nested; they hold for the whole application, so two threads shouldn't open them crosswise. Yields the scope's folder.
    """
    app, before = spark.sparkContext.applicationId, dict(spark.conf.getAll)
    outer = shared_folder(spark)
    had, own = IN_USE.get(app), folder(spark, "scope")
    IN_USE[app] = own
    try:
        yield own
    finally:
        if had is None:
            del IN_USE[app]
        else:
            IN_USE[app] = had
        assert own.startswith(f"{outer}/scope-")
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        restore(spark, before)


def restore(spark: SparkSession, before: dict[str, str]) -> None:
    """Session settings that were changed or added go back; those that a session can't change are left."""
    now = dict(spark.conf.getAll)
    for key in now.keys() | before.keys():
        if now.get(key) == before.get(key):
            continue
        try:
            spark.conf.set(key, before[key]) if key in before else spark.conf.unset(key)
        except PySparkException:
            pass
