"""Integer vectors: from an embedding column to matrices of bounded blocks, and exact products of these."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.llm.arrays import one_array

SCALE = 256
MOST = 1 << 26  #: an integer component's largest amount; greater ones are cut to it, so that products fit 64 bits
EXACT = 1 << 53


def finite(v: Column) -> Column:
    """The vector isn't null and has no null or non-finite component."""
    return v.isNotNull() & F.forall(v.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def integers(v: Column) -> Column:
    """floor(256 * x) of each component x as a double, cut to ``MOST``: array<int>."""
    return F.transform(v.cast("array<double>"), lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return pc.list_flatten(one_array(column)).to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimensions)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact; in doubles where no sum can leave their exact range."""
    most = [int(np.abs(x).max()) if x.size else 0 for x in (a, b)]
    if most[0] * most[1] * max(a.shape[1], 1) < EXACT:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def chunks(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """A task's rows in tables of so many (the last may be smaller)."""
    held, n = [], 0
    for batch in it:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)
