"""A table whose rows are applied to, not only planned for: bucketed Parquet folders, and a manifest for each version.

A write reads the buckets that its keys fall in, merges them with Spark, writes them to a new folder, and then makes one
small manifest that names the folder of every bucket. The manifest is renamed into place, which fails if its number is taken; so a
version is there whole or not at all, a writer that dies leaves the old one, and of two writers who began from one version
the second gets ``Conflict``. What belongs to a version, like the cursor up to which a feed was read, stands in its manifest and so
comes and goes with it. Old versions stay readable until ``vacuum``.

A task writes one bucket, so a table is created with as many as its size takes (``buckets_for``).
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"
BUCKET_ROWS = 1 << 20
KEPT = 2  #: versions that ``vacuum`` keeps


class Conflict(RuntimeError):
    """Another writer has made the next version."""


@dataclass(frozen=True)
class Version:
    number: int
    key: str
    buckets: int
    schema: str
    folders: dict[str, str] = field(default_factory=dict)  # of each bucket that isn't empty
    marks: dict[str, str] = field(default_factory=dict)


def buckets_for(rows: int, each: int = BUCKET_ROWS) -> int:
    return max(1, math.ceil(rows / each))


class VersionedTable:
    """Versions of a table at a place that the driver and all executors share."""

    def __init__(self, spark: SparkSession, place: str) -> None:
        self.spark, self.place = spark, place.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self.path = hadoop.Path
        self.files = self.path(self.place).getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = hadoop.FileContext.getFileContext(self.path(self.place).toUri(), spark._jsc.hadoopConfiguration())

    # what is there

    def numbers(self) -> list[int]:
        """Numbers of the versions that can be read, in order."""
        folder = self.path(f"{self.place}/versions")
        if not self.files.exists(folder):
            return []
        names = (s.getPath().getName() for s in self.files.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def version(self, number: int | None = None) -> Version | None:
        """A version, by default the last one; None if there is none yet."""
        known = self.numbers()
        if not known:
            return None
        stream = self.files.open(self.path(f"{self.place}/versions/{known[-1] if number is None else number}.json"))
        try:
            return Version(**json.loads(bytes(stream.readAllBytes())))
        finally:
            stream.close()

    def read(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, all or those of some buckets."""
        now = self.version(number)
        kind = StructType.fromJson(json.loads(now.schema))
        paths = [f"{self.place}/data/{f}/{BUCKET}={b}" for b, f in sorted(now.folders.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    # writes

    def create(self, rows: DataFrame, key: str, buckets: int | None = None, marks: dict[str, str] | None = None) -> Version:
        """The first version, with the given rows."""
        if self.version() is not None:
            raise Conflict(f"there is a table at {self.place}")
        new = Version(1, key, buckets or buckets_for(rows.count()), json.dumps(rows.schema.jsonValue()), marks=marks or {})
        return self.commit(self.written(new, rows, {}))

    def rewrite(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], marks: dict[str, str] | None = None) -> Version:
        """The next version: merge(old rows, changes) in the buckets that the keys of changes fall in; the others stay as they are.

        changes are read twice, so they have to give the same rows again: a table, or a persisted frame.
        """
        now = self.version()
        touched = [r[BUCKET] for r in changes.select(bucket(now).alias(BUCKET)).distinct().collect()]  # ``buckets`` at most
        rows = merge(self.read(now.number, touched), changes).select(*[f["name"] for f in json.loads(now.schema)["fields"]])
        after = Version(now.number + 1, now.key, now.buckets, now.schema, {b: f for b, f in now.folders.items() if int(b) not in touched}, now.marks | (marks or {}))
        return self.commit(self.written(after, rows, after.folders) if touched else after)

    def written(self, version: Version, rows: DataFrame, others: dict[str, str]) -> Version:
        """version with the folders of the rows' buckets, which are written here; no reader sees them before ``commit``."""
        folder = uuid.uuid4().hex
        path = f"{self.place}/data/{folder}"
        rows.withColumn(BUCKET, bucket(version)).repartition(version.buckets, BUCKET).write.option("compression", "zstd").partitionBy(BUCKET).parquet(path)
        names = [s.getPath().getName() for s in self.files.listStatus(self.path(path))]
        own = {n.split("=")[1]: folder for n in names if n.startswith(f"{BUCKET}=")}
        return Version(**(asdict(version) | {"folders": others | own}))

    def commit(self, version: Version) -> Version:
        """Make a version the last one, at once."""
        hidden, shown = (self.path(f"{self.place}/versions/{n}") for n in (f".{uuid.uuid4().hex}", f"{version.number}.json"))
        stream = self.files.create(hidden, True)
        stream.write(bytearray(json.dumps(asdict(version)).encode()))
        stream.close()
        kinds = self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        never_over = self.spark._sc._gateway.new_array(kinds_class(self.spark), 1)
        never_over[0] = kinds.getEnumConstants()[0]
        try:
            self.context.rename(hidden, shown, never_over)
        except Exception as failed:
            self.files.delete(hidden, False)
            if self.files.exists(shown):
                raise Conflict(f"version {version.number} was made by another writer") from failed
            raise
        return version

    def vacuum(self, keep: int = KEPT) -> None:
        """Remove all versions but the last ones, and the folders that none of these names."""
        known = self.numbers()
        live = {f for n in known[-keep:] for f in self.version(n).folders.values()}
        for n in known[:-keep]:
            self.files.delete(self.path(f"{self.place}/versions/{n}.json"), False)
        for status in self.files.listStatus(self.path(f"{self.place}/data")):
            if status.getPath().getName() not in live:
                self.files.delete(status.getPath(), True)


def kinds_class(spark: SparkSession):
    return getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")


def bucket(version: Version) -> Column:
    return F.pmod(F.xxhash64(F.col(version.key)), F.lit(version.buckets)).cast("int")
