"""A folder of one small file for each record, as a data source that Spark reads and writes.

Reading: the files are dealt by a hash of their name into shares of about ``files`` (an option), one partition each and ``SHARES`` at
most. Writing: a task writes its files to a folder of its own inside a staging folder; when all tasks are done, each file is renamed into
its place, so that a reader never sees half a file, nor any of a job that failed; a task that is tried again has another folder.
mode("append") replaces files of the same record, mode("overwrite") also removes all others.

Names are nowhere held as a whole: a task goes through the folder and takes those of its share, and the driver, which renames,
goes through the tasks' folders one name at a time.

The folder has to be one that the driver and all executors see as a path of their own (``file://`` or plain). Names are
percent-encoded record ids.
"""

from __future__ import annotations

import os
import shutil
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "record_id string, body string"
FILES, FILES_AT_ONCE = 256, 64
SHARES = 64  #: a folder is gone through once for each
STAGING = ".staging-"


def local(path: str) -> str:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"one file a record needs a folder that is mounted, not {url.scheme}")
    return unquote(url.path) if url.scheme else path


def file_name(record_id: str, suffix: str) -> str:
    if not record_id:
        raise ValueError("a record without an id has no file")
    name = quote(record_id, safe="")
    return (f"%2E{name[1:]}" if name.startswith(".") else name) + suffix


def names_in(folder: str) -> Iterator[str]:
    """Names in a folder, as they come; none if it isn't there."""
    try:
        with os.scandir(folder) as found:
            for e in found:
                yield e.name
    except FileNotFoundError:
        return


def in_share(name: str, share: int, shares: int) -> bool:
    return zlib.crc32(os.fsencode(name)) % shares == share


def moved(source: str, target: str) -> None:
    """Rename all files of a folder into another; it is gone through until it is empty."""
    some = True
    while some:
        some = False
        for name in names_in(source):
            os.replace(os.path.join(source, name), os.path.join(target, name))
            some = True


@dataclass
class Share(InputPartition):
    share: int
    shares: int


@dataclass
class Written(WriterCommitMessage):
    folder: str


class RecordFiles(DataSource):
    """Options: path, suffix (".json"), files (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> "Reader":
        return Reader(local(self.options["path"]), self.options.get("suffix", ".json"), int(self.options.get("files", FILES)))

    def writer(self, schema: StructType, overwrite: bool) -> "Writer":
        return Writer(local(self.options["path"]), self.options.get("suffix", ".json"), overwrite)


class Reader(DataSourceReader):
    def __init__(self, folder: str, suffix: str, files: int) -> None:
        self.folder, self.suffix, self.files = folder, suffix, files

    def names(self) -> Iterator[str]:
        return (n for n in names_in(self.folder) if n.endswith(self.suffix) and not n.startswith("."))

    def partitions(self) -> list[Share]:
        shares = min(SHARES, max(1, -(-sum(1 for _ in self.names()) // self.files)))
        return [Share(k, shares) for k in range(shares)]

    def body(self, name: str) -> str | None:
        try:
            with open(os.path.join(self.folder, name), encoding="utf-8", newline="") as f:
                return f.read()
        except (OSError, UnicodeDecodeError):  # gone meanwhile, or no text
            return None

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        own = (n for n in self.names() if in_share(n, partition.share, partition.shares))
        while some := list(islice(own, FILES_AT_ONCE)):
            ids = [unquote(n.removesuffix(self.suffix)) for n in some]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(map(self.body, some), pa.string())], names=["record_id", "body"])


class Writer(DataSourceWriter):
    def __init__(self, folder: str, suffix: str, overwrite: bool) -> None:
        self.folder, self.suffix, self.overwrite = folder, suffix, overwrite
        self.staging = os.path.join(folder, STAGING + uuid.uuid4().hex)

    def write(self, rows: Iterator) -> Written:
        own = os.path.join(self.staging, uuid.uuid4().hex)
        os.makedirs(own)
        for row in rows:
            with open(os.path.join(own, file_name(row.record_id, self.suffix)), "w", encoding="utf-8", newline="") as f:
                f.write(row.body or "")
        return Written(own)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m.folder for m in messages if m]
        if self.overwrite:
            done = [self.whole(done)]
            gone = self.others(done[0])
        for own in done:
            moved(own, self.folder)
        if self.overwrite:
            for name in names_in(gone):
                os.unlink(os.path.join(self.folder, name))
        self.abort(messages)

    def whole(self, done: list[str]) -> str:
        """One folder of all that tasks have written."""
        place = os.path.join(self.staging, "whole")
        os.makedirs(place)
        for own in done:
            moved(own, place)
        return place

    def others(self, place: str) -> str:
        """A folder of empty files, named like those that stand in the folder and not at the place."""
        gone = os.path.join(self.staging, "gone")
        os.makedirs(gone)
        for name in Reader(self.folder, self.suffix, FILES).names():
            if not os.path.lexists(os.path.join(place, name)):
                open(os.path.join(gone, name), "w").close()
        return gone

    def abort(self, messages: list[Written | None]) -> None:
        """What is staged goes; whatever stood in the folder stays."""
        shutil.rmtree(self.staging, ignore_errors=True)


def read_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """record_id and body of each file; a body that can't be read is null."""
    spark.dataSource.register(RecordFiles)
    return spark.read.format("record_files").options(**options).load(path)


def write_files(rows: DataFrame, path: str, mode: str = "append", **options) -> None:
    """One file for each row (record_id, body)."""
    rows.sparkSession.dataSource.register(RecordFiles)
    rows.select("record_id", "body").write.format("record_files").options(**options).mode(mode).save(path)
