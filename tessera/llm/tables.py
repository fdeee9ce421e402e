"""Reading the tables, and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from tessera.sources.places import folder as new_place  # noqa: F401  (operators find both here)
from tessera.sources.places import written as stored  # noqa: F401

#: Arrow batches end at this many bytes (Spark's own bound, 64 MiB, is too much for several Python workers beside an executor's heap).
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
TRIM_BYTES = BATCH_BYTES  #: of batches, after which a worker gives unused memory back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Memory that a worker doesn't use any more goes back to the machine, so that idle workers don't hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_arrow(df: DataFrame, batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kinds: str | StructType) -> DataFrame:
    """df.mapInArrow with batches of at most ``BATCH_BYTES`` (a longer row is a batch of its own), in workers that give memory back.

    The size is a setting of the session, read when the plan runs; ``places.scope`` puts it back.
    """
    df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in it:
            seen += batch.nbytes
            yield batch
            del batch
            if seen >= TRIM_BYTES:
                give_back()
                seen = 0

    def tidy(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(counted(it))
        give_back()

    return df.mapInArrow(tidy, kinds)


def nullable(kind: DataType) -> DataType:
    """The type with nulls allowed everywhere inside, as Arrow batches come back from Python."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, nullable(f.dataType)) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(nullable(kind.elementType))
    if isinstance(kind, MapType):
        return MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct, ``row``; so their names clash with nothing."""
    return F.struct("*").cast(nullable(docs.schema)).alias("row")


def with_row(docs: DataFrame, more: str) -> StructType:
    """The type of rows that hold ``row`` and further columns."""
    return StructType([StructField("row", nullable(docs.schema)), *StructType.fromDDL(more)])
