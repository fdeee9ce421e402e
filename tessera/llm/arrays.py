"""Array views of Arrow text batches, shared by the Arrow-batched operators.

Texts are handled as UTF-8 bytes in slices of whole documents, about ``SLICE_BYTES`` each, so that a
task's memory follows the longest single text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SCORED_BYTES = 1 << 18  #: of texts that are scored together: each byte takes many times its size in n-grams
KNOWN_BYTES = 8 << 20  #: of strings that a worker remembers (``Known``), each with 16 bytes besides
LONGEST = 64  #: bytes of a string that is remembered for long
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)

#: Bytes \x20 and \x09-\x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random value for each byte, from the finaliser.
BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _ODD) | _U(1)


def powers(n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), _U(base))
    out[0] = _U(1)
    return np.multiply.accumulate(out)


def texts_of(batch: pa.RecordBatch, inside: int | None) -> pa.Array:
    """The texts of a batch: its second column, or the field ``inside`` of its first one, a whole row as a struct."""
    return batch.column(1) if inside is None else pc.struct_field(batch.column(0), [inside])


def place_of_text(columns: list[str]) -> int:
    return [c.lower() for c in columns].index("text")


@dataclass
class Texts:
    """Some whole texts: rows ``lo`` to ``hi`` of the batch, their bytes and their offsets in these."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo


def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Slices of a string column; a null text counts as empty."""
    column = pc.fill_null(one_array(column), "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield Texts(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; all else stays."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


@dataclass
class Runs:
    """Maximal runs of marked bytes that end with their text: start, end, text number of each, and runs before each text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def runs(mask: np.ndarray, offsets: np.ndarray) -> Runs:
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    begins = mask.copy()
    begins[1:] &= ~mask[:-1] | edge[1:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    return Runs(start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run; runs are disjoint and ordered."""
    if not len(start):
        return np.zeros(0, _U)
    size = end - start
    total = np.cumsum(size)
    inside = np.arange(total[-1]) - np.repeat(total - size, size)
    at = np.repeat(start, size) + inside
    values = BYTE_VALUE[data[at]]
    values *= powers(int(size.max()))[inside]
    full = size > 0
    out = np.zeros(len(start), _U)
    if full.any():
        out[full] = np.add.reduceat(values, (total - size)[full])
    return mix(out + size.astype(_U) * _ODD)


def windows(word_hash: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows inside texts, and the number of windows before each text.

    Window i of a text starts at its word i; a text of n words has max(0, n - size + 1) of them.
    """
    counts = np.diff(first)
    each = np.maximum(counts - size + 1, 0)
    before = np.concatenate([[0], np.cumsum(each)])
    at = np.arange(before[-1]) + np.repeat(first[:-1] - before[:-1], each)
    out = np.zeros(len(at), _U)
    for k in range(size):
        out = mix(out * _ODD + word_hash[at + k]) if k + 1 == size else out * _ODD + mix(word_hash[at + k])
    return out, before


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of values[first[i]:first[i+1]] for each text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], ..., begin[0] + size[0] - 1, begin[1], ..."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - size), size)


def text_batches(column: pa.Array, limit: int) -> Iterator[tuple[int, pa.Array]]:
    """Whole texts of a column, about ``limit`` bytes at a time, and the number of the first; null is ''."""
    column = pc.fill_null(one_array(column), "").cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield lo, column.slice(lo, hi - lo)
        lo = hi


class Known:
    """Strings with a number each, and how often each was asked for."""

    def __init__(self) -> None:
        self.strings, self.uses = pa.array([""], pa.large_string()), np.zeros(1, np.int64)

    def find(self, asked: pa.Array) -> np.ndarray:
        """The number of each string, -1 where it isn't known."""
        return pc.fill_null(pc.index_in(asked, value_set=self.strings), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, more: pa.Array) -> None:
        self.strings = pa.concat_arrays([self.strings, more])
        self.uses = np.append(self.uses, np.zeros(len(more), np.int64))

    def often(self) -> np.ndarray:
        """Numbers of those to keep when there are too many: the most used, up to half of the bytes; '' is number 0."""
        size = pc.binary_length(self.strings).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((np.arange(len(size)), -self.uses, size > LONGEST))
        order = order[order > 0]
        order = order[(size[order] <= LONGEST) & (np.cumsum(size[order] + 16) <= KNOWN_BYTES // 2)]
        return np.append(0, np.sort(order))

    @property
    def full(self) -> bool:
        return self.strings.nbytes + 16 * len(self.strings) > KNOWN_BYTES
