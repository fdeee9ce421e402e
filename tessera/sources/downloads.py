"""Files on disk held against what is expected of them: size first, then the digest of their bytes.

Folders are listed and files are read in tasks, so neither names nor bytes pass through the driver; the folder has to be mounted on all.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.file_store import SHARES, in_share, local

MOST_BYTES = 1 << 30  #: larger files aren't read
LISTED_AT_ONCE = 4096


def walked(top: str, share: int, shares: int) -> Iterator[tuple[str, bytes, int]]:
    """name, path and size of the files of a share in a folder and those inside; without hidden ones, as Spark reads folders."""
    folders = [top]
    while folders:
        with os.scandir(folders.pop()) as found:
            for e in found:
                if e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name or e.name.endswith("._COPYING_"):
                    continue
                if e.is_dir():
                    folders.append(e.path)
                elif in_share(e.path, share, shares):
                    try:
                        yield os.fsencode(e.name).decode("utf-8", "replace"), os.fsencode(e.path), e.stat().st_size
                    except FileNotFoundError:  # gone meanwhile
                        pass


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """name, path (bytes) and length of the files of a folder and those inside, listed in ``SHARES`` tasks.

    Spark can't tell how many there are, so what is joined with it needs the hint ``merge``.
    """
    top = local(folder)
    if not os.path.isdir(top):
        raise FileNotFoundError(folder)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for share in batch.column(0).to_pylist():
                own = walked(top, share, SHARES)
                while some := list(islice(own, LISTED_AT_ONCE)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.binary(), pa.int64()))], names=["name", "path", "length"])

    return spark.range(0, SHARES, 1, SHARES).mapInArrow(rows, "name string, path binary, length long")


def checked(spark: SparkSession, folder: str, expected: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """name and status of every expected (name, size, sha256) or found file: ok, missing, unexpected, too large, size or digest.

    Only files whose size is right, and at most ``most``, are read and digested.
    """
    known = expected.select("name", F.col("size").alias("_size"), F.col("sha256").alias("_sha256"))
    both = known.hint("merge").join(listed(spark, folder), "name", "full_outer")
    status = F.when(F.col("_size").isNull(), "unexpected").when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("_size"), "size").when(F.col("_size") > most, "too large")

    def status_of(path: bytes, digest: str | None) -> str:
        try:
            with open(path, "rb") as f:
                return "ok" if hashlib.file_digest(f, "sha256").hexdigest() == digest else "digest"
        except FileNotFoundError:  # gone meanwhile
            return "missing"

    def digested(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s or status_of(path, digest) for s, path, digest in rows], pa.string())], names=["name", "status"])

    return both.select("name", status.alias("status"), "path", "_sha256").mapInArrow(digested, "name string, status string")


def quarantined(files: DataFrame, folder: str, aside: str) -> None:
    """Move the files of some names out of a folder, task by task; one that is gone already is no error."""
    source, target = local(folder), local(aside)
    os.makedirs(target, exist_ok=True)

    def move(rows: Iterator) -> None:
        for r in rows:
            try:
                os.replace(os.path.join(source, r.name), os.path.join(target, r.name))
            except FileNotFoundError:
                pass

    files.select("name").foreachPartition(move)

