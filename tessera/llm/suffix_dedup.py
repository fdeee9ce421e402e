"""Removal of repeated passages: every byte covered by a 100-byte string that also starts earlier.

A distributed suffix sort by a difference cover, cut to what prefixes of 100 bytes need. Sampled positions of a text are those
whose residue modulo 57 is in a perfect difference set: of any two positions, some 0 to 56 bytes on, both are sampled at
once, and of two equal 100-byte strings at least 44 equal bytes follow there.

(1) Sampled strings of 44 bytes (``NAME``) are named by their hashes, and the names are sorted and counted; those that occur
once drop out. (2) The names that are left go on with their neighbourhoods (up to 56 bytes before and 100 bytes after
the start): these are named by 96 bits (of two independent hashes) and sorted in turn, and of equal ones only the first goes on; all 100-byte strings in
the others are repeats. Of 10**12 such strings, two different ones share a name with a probability of 1e-5. (3) What is left, different neighbourhoods of one name, is merged: all suffixes that start in them are sorted by
their prefixes of 100 bytes, and equal ones stand next to each other; all but the first are repeats. Neighbours are
compared byte by byte. A name of over ``FREQUENT`` places (a line between bytes of each text's own) isn't
merged in one place: its 100-byte strings are named one by one in step 2, by 96 bits too.

Texts are dealt into blocks of about ``BLOCK_BYTES``, by one shuffle that all steps read. A block sends its sorted names to
their ranges, packed, one row a range, and gets back bits in the same order; no names and no texts go
through the driver. Texts that are equal as a whole are found by 128 bits of hash first; of them the first is looked at alone.

Texts are UTF-8 bytes; matches don't cross texts; order is that of doc_id, then of a hash of id and text (``place``, 64 bits), then of
the start; blocks are ranges of that hash, so a text's block and number in it tell its place among texts of one id. Defined
cases: a null text is empty; texts under 100 bytes stay; null ids come last, their texts in the order of the hash, as texts that share an
id; rows of equal id and text are one document, looked at once, and get equal results; ids have to be integers (others raise
ValueError); an empty table gives an empty result; extra columns stay, whatever their names. A long text is looked at in overlapping stretches, so that memory follows the block and not the text's arrays.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm.arrays import BYTE_VALUE, mix, one_array, place_of_text, powers, spread
from tessera.llm.tables import give_back, in_arrow, stored, whole_row, with_row

LENGTH = 100  #: bytes of a repeat
MODULUS = 57
#: A perfect difference set; each residue modulo 57 is the difference of two of these.
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
NAME = LENGTH - MODULUS + 1  #: bytes that surely follow a common sample of two equal strings
BEFORE = MODULUS - 1  #: bytes before a sample at which a string that holds its name may start
BLOCK_BYTES = 8 << 20
TASK_BLOCKS = 4  #: blocks of a task, on average, where the session's shuffle partitions are fewer
STRETCH = MODULUS << 12  #: bytes of a text that are looked at together
SLICE_BYTES = 1 << 18
POWERS_STEP = 1 << 16  #: tables of powers grow by whole multiples of this
FREQUENT = 1 << 15  #: places of a name beyond which its strings are named one by one
SPARE_BITS = 7  #: by which names are longer than their number needs; one in 2**7 unique names goes on for nothing
LAST_ID = (1 << 63) - 1
COPIES, SEEN, FIRST, SPANS, STREAM = range(5)  #: kinds of rows that go between blocks and ranges
SALTS = 32  #: parts that the rows of one id and text are dealt into
CUT = "kept binary, n_bytes long, spans array<struct<start:bigint,end:bigint>>"
CUT_COLUMNS = ("kept", "n_bytes", "spans")
ROW = "range int, block int, kind int, place int, data binary"
_U = np.uint64


class Rolling:
    """Hashes of stretches of some bytes; ``more`` gives further bits, independent of the first."""

    bases = (0xD6E8FEB86659FD93, 0xA24BAED4963EE407)
    values = (BYTE_VALUE, mix(BYTE_VALUE))
    forth = [powers(1 << 10, b) for b in bases]
    back = [powers(1 << 10, pow(b, -1, 1 << 64)) for b in bases]

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.sums = data, [None, None]

    def hashed(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(self.data)
        if n >= len(Rolling.forth[k]):
            size = (n // POWERS_STEP + 1) * POWERS_STEP
            Rolling.forth[k] = powers(size, self.bases[k])
            Rolling.back[k] = powers(size, pow(self.bases[k], -1, 1 << 64))
        if self.sums[k] is None:
            self.sums[k] = np.concatenate([[_U(0)], np.cumsum(self.values[k][self.data] * Rolling.forth[k][:n], dtype=_U)])
        return mix((self.sums[k][end] - self.sums[k][start]) * Rolling.back[k][start] + (end - start).astype(_U))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.hashed(0, start, end)

    def more(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.hashed(1, start, end) >> _U(32)).astype(np.uint32)


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane, deflated."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns) if n else b""
    return n.to_bytes(4, "little") + zlib.compress(planes, 1)


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    n, raw, at, out = int.from_bytes(blob[:4], "little"), np.frombuffer(zlib.decompress(blob[4:]), np.uint8), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def steps(ordered: np.ndarray) -> np.ndarray:
    """Ordered numbers as differences, which pack well."""
    return np.diff(ordered, prepend=ordered.dtype.type(0))


def rows_of(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["range", "block", "kind", "place", "data"])


class Block:
    """The texts of a block, and what is known about them from the steps before."""

    def __init__(self, docs: pa.Table, side: pa.Table, inside: int) -> None:
        """docs: ord, place, tag, more, row; ``inside``: the text's place in row. side: rows that came back to this block."""
        ord_, place, tag, more = (docs.column(c).to_numpy() for c in ("ord", "place", "tag", "more"))
        self.text = pc.fill_null(pc.struct_field(one_array(docs.column("row")), [inside]), "").cast(pa.large_binary())
        order = np.lexsort((more, tag, place.view(_U), ord_))
        new = np.append(True, np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in (ord_, tag, more)])) if len(order) else np.zeros(0, bool)
        self.of = np.empty(len(order), np.int64)  # each row's document
        self.of[order] = np.cumsum(new) - 1
        self.row = order[new]  # a row of each document
        self.ord = ord_[self.row]
        self.size = pc.binary_length(self.text).to_numpy(zero_copy_only=False).astype(np.int64)[self.row]
        kinds, places, data = (side.column(c).to_pylist() for c in ("kind", "place", "data"))
        self.flags = {k: b"".join(zlib.decompress(x) for _, x in sorted((p, x) for p, kind, x in zip(places, kinds, data) if kind == k)) for k in (SEEN, FIRST)}
        self.marked: np.ndarray | None = None
        self.spans = [x for kind, x in zip(kinds, data) if kind == SPANS]
        self.copies = b"".join(x for kind, x in zip(kinds, data) if kind == COPIES)
        known = {(a, b): first for a, b, first in np.frombuffer(self.copies, ">i8").reshape(-1, 3).tolist()}
        self.copy = np.array([o > known.get((t, m), LAST_ID) for o, t, m in zip(*(c[self.row].tolist() for c in (ord_, tag, more)))], bool)

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Some bytes, and of each sample in them its place, its stretch's first and end place, its document, and what to add to a place to have it in the document."""
        parts, size = [], 0
        for k in np.flatnonzero(~self.copy & (self.size >= LENGTH)).tolist():
            raw = np.frombuffer(self.text[int(self.row[k])].as_buffer(), np.uint8)
            for core in range(0, len(raw), STRETCH):
                lo, hi = max(0, core - BEFORE), min(len(raw), core + STRETCH + LENGTH)
                parts.append((k, core, lo, raw[lo:hi], len(raw)))
                size += hi - lo
                if size >= SLICE_BYTES:
                    yield self.samples(parts)
                    parts, size = [], 0
        if parts:
            yield self.samples(parts)

    def samples(self, parts: list[tuple]) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(p[3]) for p in parts])
        first = np.cumsum(sizes) - sizes
        doc, core, lo, whole = (np.array([p[c] for p in parts]) for c in (0, 1, 2, 4))
        stop = np.minimum(core + STRETCH, whole - NAME + 1)
        n = -(-np.maximum(stop - core, 0) // MODULUS)
        own = np.repeat(np.repeat(np.arange(len(parts)), n), len(COVER))
        at = (spread(np.zeros(len(n), np.int64), n)[:, None] * MODULUS + np.array(COVER)).ravel() + core[own]  # in the document
        on = np.flatnonzero(at < stop[own])
        own = own[on]
        return np.concatenate([p[3] for p in parts]), at[on] + (first - lo)[own], first[own], (first + sizes)[own], doc[own], (lo - first)[own]

    def names(self, bits: int) -> np.ndarray:
        """The names of all samples, in the order of ``slices``, cut to some bits."""
        out = [np.zeros(0, _U)]
        for data, at, *_ in self.slices():
            out.append(Rolling(data)(at, at + NAME) >> _U(64 - bits))
        return np.concatenate(out)

    def marks(self, bits: int) -> np.ndarray:
        """What is known about the names of all samples: 0 if a name occurs once, 2 if it is frequent, else 1."""
        if self.marked is None:
            names = self.names(bits)
            order = np.argsort(names)
            ordered = names[order]
            number = np.cumsum(np.append(0, ordered[1:] != ordered[:-1])) if len(names) else order
            self.marked = np.empty(len(names), np.uint8)
            self.marked[order] = np.frombuffer(self.flags[SEEN], np.uint8)[number]
        return self.marked

    def neighbourhoods(self, bits: int) -> Iterator[tuple[np.ndarray, Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each slice the samples of repeated names: bytes, hashes, and of each its place, first and end place of its
        neighbourhood, document, what to add to places, and 2 for a frequent name, else 1."""
        marks, done = self.marks(bits), 0
        for data, at, first, end, doc, add in self.slices():
            mark = marks[done : done + len(at)]
            done += len(at)
            on = np.flatnonzero(mark)
            if len(on):
                at, first, end, doc, add, mark = (x[on] for x in (at, first, end, doc, add, mark))
                start, stop = np.maximum(at - BEFORE, first), np.minimum(at + LENGTH, end)
                yield data, Rolling(data), at, start, stop, doc, add, mark

    def entries(self, bits: int) -> "Entries":
        """Neighbourhoods, and the single strings of frequent names."""
        parts = [[np.zeros(0, _U), np.zeros(0, np.uint32)] + [np.zeros(0, np.int64)] * 3]
        for _, roll, _, start, stop, doc, add, mark in self.neighbourhoods(bits):
            single = mark == 2
            n = np.where(single, stop - start - LENGTH + 1, 1)
            own = np.repeat(np.arange(len(n)), n)
            lo = spread(start, n)
            hi = np.where(single[own], lo + LENGTH, stop[own])
            parts.append([roll(lo, hi), roll.more(lo, hi), doc[own], lo + add[own], hi + add[own]])
        return Entries(*(np.concatenate(x) for x in zip(*parts)))


class Entries:
    """Hashed strings of a block with their documents and places, in the order of ``neighbourhoods``; ``once``: of equal ones the first."""

    def __init__(self, name: np.ndarray, more: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.name, self.more, self.doc, self.start, self.end = name, more, doc, start, end
        order = np.lexsort((start, doc, more, name))
        new = np.append(True, (name[order][1:] != name[order][:-1]) | (more[order][1:] != more[order][:-1])) if len(order) else np.zeros(0, bool)
        self.once = order[new]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def again(self, flags: bytes) -> np.ndarray:
        """Which are repeats: those that stand elsewhere than the first of equal ones, and all if flags say it of the first."""
        first = self.once[self.of]
        return (self.doc != self.doc[first]) | (self.start != self.start[first]) | (np.frombuffer(flags, np.uint8)[self.of] > 0)


def cut_at(ordered: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where the ranges of numbers of some bits begin in ordered ones."""
    edges = np.array([(k << bits) // ranges for k in range(ranges)], _U)
    return np.append(np.searchsorted(ordered, edges), len(ordered))


def in_ranges(number: int, ordered: np.ndarray, bits: int, ranges: int, packed: Callable[[slice], bytes]) -> list[tuple]:
    """Rows that bring the parts of ordered numbers to their ranges."""
    cuts = cut_at(ordered, bits, ranges).tolist()
    return [(k, number, STREAM, k, packed(slice(a, b))) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]


def passed_on(number: int, block: Block, ranges: int, *kinds: int) -> list[tuple]:
    """Rows that come back to the block with what it knows already."""
    out = [(number % ranges, number, k, 0, zlib.compress(block.flags[k], 1)) for k in kinds]
    return out + [(number % ranges, number, COPIES, 0, block.copies)] * bool(block.copies)


def sends_names(number: int, block: Block, bits: int, ranges: int) -> list[tuple]:
    names = np.sort(block.names(bits))
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
    once, times = names[first], np.minimum(np.diff(np.append(first, len(names))), 0xFFFF).astype(np.uint16)
    return in_ranges(number, once, bits, ranges, lambda s: pack(steps(once[s]), times[s])) + passed_on(number, block, ranges)


def sends_entries(number: int, block: Block, bits: int, ranges: int) -> list[tuple]:
    e = block.entries(bits)
    name, more, doc, start = e.name[e.once], e.more[e.once], e.doc[e.once], e.start[e.once].astype(np.uint32)
    return in_ranges(number, name, 64, ranges, lambda s: pack(steps(name[s]), more[s], block.ord[doc[s]], doc[s].astype(np.uint32), start[s])) + passed_on(number, block, ranges, SEEN)


def sends_units(number: int, block: Block, bits: int, ranges: int) -> list[tuple]:
    """Neighbourhoods that aren't repeats, by name, with their bytes."""
    again, done = block.entries(bits).again(block.flags[FIRST]), 0
    held: list[list[np.ndarray]] = []
    texts: list[bytes] = []
    for data, roll, at, start, stop, doc, add, mark in block.neighbourhoods(bits):
        n = np.where(mark == 2, stop - start - LENGTH + 1, 1)
        first = done + np.cumsum(n) - n
        done += int(n.sum())
        on = np.flatnonzero((mark == 1) & (stop - start >= LENGTH) & ~again[first])
        raw = data.tobytes()
        held.append([roll(at[on], at[on] + NAME) & ~_U(0xFFFF), doc[on], (start + add)[on]])
        texts.extend(raw[a:b] for a, b in zip(start[on].tolist(), stop[on].tolist()))
    if not texts:
        return passed_on(number, block, ranges, SEEN, FIRST)
    name, doc, start = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((start, doc, name))
    name, doc, start = name[order], doc[order], start[order]
    texts = [texts[k] for k in order.tolist()]
    size = np.array([len(x) for x in texts], np.uint8)

    def packed(s: slice) -> bytes:
        numbers = pack(steps(name[s]), block.ord[doc[s]], doc[s].astype(np.uint32), start[s].astype(np.uint32), size[s])
        return len(numbers).to_bytes(4, "little") + numbers + zlib.compress(b"".join(texts[s]), 1)

    return in_ranges(number, name, 64, ranges, packed) + passed_on(number, block, ranges, SEEN, FIRST)


def counted_names(rows: list[tuple[int, int, bytes]], frequent: int) -> list[tuple]:
    """For each block's names of a range: 0 if a name occurs once in all, 2 if over ``frequent`` times, else 1."""
    got = [unpack(data, _U, np.uint16) for _, _, data in rows]
    sizes = np.cumsum([len(g[0]) for g in got])[:-1]
    name, where = np.unique(np.concatenate([np.cumsum(g[0], dtype=_U) for g in got]), return_inverse=True)
    total = np.bincount(where, np.concatenate([g[1] for g in got]), len(name))
    flag = ((total > 1).astype(np.uint8) + (total > frequent).astype(np.uint8))[where]
    return [(0, block, SEEN, place, zlib.compress(own.tobytes(), 1)) for (block, place, _), own in zip(rows, np.split(flag, sizes))]


def first_entries(rows: list[tuple[int, int, bytes]]) -> list[tuple]:
    """For each block's strings of a range: 1 if an equal one stands earlier, else 0."""
    got = [unpack(data, _U, np.uint32, np.int64, np.uint32, np.uint32) for _, _, data in rows]
    sizes = np.cumsum([len(g[0]) for g in got])[:-1]
    name = np.concatenate([np.cumsum(g[0], dtype=_U) for g in got])
    more, ord_, doc, start = (np.concatenate([g[k] for g in got]) for k in (1, 2, 3, 4))
    own = np.repeat(np.array([block for block, _, _ in rows], np.int32), [len(g[0]) for g in got])
    order = np.lexsort((start, doc, own, ord_, more, name))
    flag = np.zeros(len(order), np.uint8)
    flag[order[1:]] = (name[order][1:] == name[order][:-1]) & (more[order][1:] == more[order][:-1])
    return [(0, block, FIRST, place, zlib.compress(own.tobytes(), 1)) for (block, place, _), own in zip(rows, np.split(flag, sizes))]


MERGED = 1 << 12  #: neighbourhoods that are merged at a time, in whole names


def merged_units(rows: list[tuple[int, int, bytes]]) -> list[tuple]:
    """Stretches of repeats among the neighbourhoods of a range, by block."""
    columns, texts = [], []
    for block, _, data in rows:
        n = int.from_bytes(data[:4], "little")
        step, *more = unpack(data[4 : 4 + n], _U, np.int64, np.uint32, np.uint32, np.uint8)
        columns.append([np.cumsum(step, dtype=_U), *more, np.full(len(step), block, np.int64)])
        texts.append(zlib.decompress(data[4 + n :]))
    name, ord_, doc, start, size, block = (np.concatenate(x) for x in zip(*columns))
    size, start = size.astype(np.int64), start.astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(size) - size
    order = np.lexsort((start, doc, block, ord_, name))
    found = []
    lo = 0
    while lo < len(order):
        hi = min(lo + MERGED, len(order))
        hi = int(np.searchsorted(name[order], name[order[hi - 1]], "right"))
        own = order[lo:hi]
        lo = hi
        if len(own) > 1:
            some = data[spread(begin[own], size[own])]
            _, rank = np.unique(np.stack([ord_[own], block[own], doc[own].astype(np.int64)], 1), axis=0, return_inverse=True)
            row, first, last = repeated_windows(name[own], some, size[own], (rank.ravel() << 32) + start[own])
            found.append([block[own[row]], doc[own[row]].astype(np.uint32), (start[own[row]] + first).astype(np.uint32), (start[own[row]] + last + LENGTH).astype(np.uint32)])
    if not found:
        return []
    block, doc, begin, end = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(block, kind="stable")
    blocks, first = np.unique(block[order], return_index=True)
    return [(0, b, SPANS, rows[0][1], pack(doc[o], begin[o], end[o])) for b, o in zip(blocks.tolist(), np.split(order, first[1:]))]


def repeated_windows(name: np.ndarray, data: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of ``LENGTH`` bytes that an earlier one of the same name equals, as stretches: neighbourhood, first and last string.

    ``place``: of each neighbourhood, in the order of all texts. A string may be in several neighbourhoods. Strings are
    sorted by the hashes of their bytes, then by their places; each is compared with the first of its kind, whole or,
    where both go on as those before them do, by its last byte.
    """
    n = size - LENGTH + 1
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[row] + inside
    here = place[row] + inside
    prefix = Rolling(data)(at, at + LENGTH) ^ mix(name)[row]
    order = np.lexsort((here, prefix))
    new = np.append(True, prefix[order][1:] != prefix[order][:-1])
    lead = np.empty(len(order), np.int64)
    lead[order] = order[new][np.cumsum(new) - 1]
    again = here != here[lead]
    other = at[lead]
    goes_on = np.zeros(len(at), bool)
    goes_on[1:] = again[1:] & again[:-1] & (row[1:] == row[:-1]) & (other[1:] == other[:-1] + 1)
    equal = data[at + LENGTH - 1] == data[other + LENGTH - 1]
    whole = np.flatnonzero(again & ~goes_on)
    for k in range(0, len(whole), 1 << 15):
        w = whole[k : k + (1 << 15)]
        inner = np.arange(LENGTH)
        equal[w] = (data[at[w][:, None] + inner] == data[other[w][:, None] + inner]).all(1)
    odd = again & ~equal  # hashes that are equal by chance: what goes on from there doesn't count either
    wrong = np.cumsum(odd)
    head = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(at))))
    again &= wrong == (wrong - odd)[head]
    begins = again & np.concatenate([[True], ~again[:-1] | (row[1:] != row[:-1])])
    ends = again & np.concatenate([~again[1:] | (row[1:] != row[:-1]), [True]])
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    return row[first], inside[first], inside[last]


def removed_runs(block: Block, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal removed runs of a block: document, start, end, in order."""
    e = block.entries(bits)
    again = e.again(block.flags[FIRST]) & (e.end - e.start >= LENGTH)
    copies = np.flatnonzero(block.copy)
    parts = [[e.doc[again], e.start[again], e.end[again]], [copies, np.zeros(len(copies), np.int64), block.size[copies]]]
    parts += [[x.astype(np.int64) for x in unpack(data, np.uint32, np.uint32, np.uint32)] for data in block.spans]
    doc, start, end = (np.concatenate(x) for x in zip(*parts))
    base = np.cumsum(block.size + 1) - block.size - 1  # documents side by side, never touching
    order = np.argsort(base[doc] + start, kind="stable")
    doc, start, end = doc[order], (base[doc] + start)[order], (base[doc] + end)[order]
    reach = np.maximum.accumulate(end) if len(end) else end
    new = np.flatnonzero(np.append(True, start[1:] > reach[:-1])) if len(end) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(end)) - 1 if len(new) else new
    return doc[new], start[new] - base[doc[new]], reach[last] - base[doc[new]]


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def cut_block(docs: pa.Table, block: Block, bits: int) -> pa.Table:
    """Each row, the bytes that are left of its text, the text's size and the removed runs."""
    doc, start, end = removed_runs(block, bits)
    first = np.searchsorted(doc, np.arange(len(block.row) + 1))
    kept = []
    for k, row in enumerate(block.row.tolist()):
        raw = block.text[row].as_py()
        a, b = first[k], first[k + 1]
        stops = [0, *np.stack([start[a:b], end[a:b]], 1).ravel().tolist(), len(raw)]
        kept.append(raw if a == b else b"".join(raw[x:y] for x, y in zip(stops[::2], stops[1::2])))
    runs = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], fields=list(SPAN)))
    of = pa.array(block.of)
    columns = [docs.column("row"), pa.array(kept, pa.binary()).take(of), pa.array(block.size).take(of), runs.take(of)]
    return pa.Table.from_arrays(columns, names=["row", "kept", "n_bytes", "spans"])


def cut_docs(docs: DataFrame, frequent: int = FREQUENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (a row of docs as a struct), ``kept`` (binary: the bytes left), ``n_bytes`` (of the text) and ``spans`` (removed: array<struct<start, end>>)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(n_bytes / block_bytes), min(parts, n_bytes >> 20))
    tasks = max(parts, math.ceil(blocks / TASK_BLOCKS))
    # a stream of names from a block to a range should hold some names at least
    ranges = max(1, min(max(parts, blocks), block_bytes * len(COVER) // MODULUS // 16))
    bits = min(60, math.ceil(math.log2(max(2, n_bytes * len(COVER) // MODULUS))) + SPARE_BITS)
    inside = place_of_text(docs.columns)
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise ValueError("doc_id has to be an integer, as it orders the texts")
    given = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("ord"),
        F.xxhash64(text).alias("tag"),
        F.xxhash64(F.lit(1), text).alias("more"),
        whole_row(docs),
    )
    # rows of one id and text come into a block once; what is found there is joined to all of them
    key = ["ord", "tag", "more"]
    counts = stored(given.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.octet_length("row.text")).alias("size")), "texts")
    several = counts.where("n > 1").select(*key)
    all_alone = several.isEmpty()
    once = given if all_alone else given.join(several, key, "left_anti").unionByName(given.join(several, key).groupBy(*key).agg(F.first("row").alias("row")))
    place = F.xxhash64("ord", "tag")
    high = F.shiftrightunsigned("place", 32)  # blocks are ranges of unsigned places
    apart = once.withColumn("place", place).withColumn("block", F.shiftright(high * blocks, 32).cast("int"))
    keyed = apart.select("ord", "place", "tag", "more", "row", "block").repartition(tasks, "block")

    def word(column: str) -> Column:
        return F.unhex(F.lpad(F.hex(column), 16, "0"))

    # whole texts that stand earlier: a row for each such text and block, whatever the number of copies
    slim = counts.where(F.col("size") >= LENGTH).withColumn("place", place).withColumn("block", F.shiftright(high * blocks, 32).cast("int")).groupBy("tag", "more", "block").agg(F.min("ord").alias("least"), F.max("ord").alias("most"))
    known = slim.groupBy("tag", "more").agg(F.min("least").alias("first"), F.max("most").alias("last")).where("first < last").select("tag", "more", "first")
    side = slim.join(known, ["tag", "more"]).where("most > first").select(F.lit(0).alias("range"), "block", F.lit(COPIES).alias("kind"), F.lit(0).alias("place"), F.concat(word("tag"), word("more"), word("first")).alias("data"))
    side = stored(side, "copies")

    def step(side: DataFrame, sends: Callable, gathers: Callable) -> DataFrame:
        """Blocks send rows to their ranges, and get back what is found there."""

        def sent(docs: pa.Table, side: pa.Table) -> pa.Table:
            if not len(docs):
                return rows_of([])
            try:
                return rows_of(sends(docs.column("block")[0].as_py(), Block(docs, side, inside), bits, ranges))
            finally:
                give_back()

        def gathered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, held = None, []
            for batch in it:
                out = []
                for range_, block, kind, place, data in zip(*(c.to_pylist() for c in batch.columns)):
                    if kind != STREAM:
                        out.append((0, block, kind, place, data))
                        continue
                    if range_ != here and held:
                        out.extend(gathers(held))
                        held = []
                    here = range_
                    held.append((block, place, data))
                yield from rows_of(out).to_batches()
            if held:
                yield from rows_of(gathers(held)).to_batches()

        rows = keyed.groupBy("block").cogroup(side.repartition(tasks, "block").groupBy("block")).applyInArrow(sent, ROW)
        return in_arrow(rows.repartition(tasks, "range").sortWithinPartitions("range", "block"), gathered, ROW)

    side = step(side, sends_names, lambda rows: counted_names(rows, frequent))
    side = step(side, sends_entries, first_entries)
    side = step(side, sends_units, merged_units)

    def cut(docs: pa.Table, side: pa.Table) -> pa.Table:
        try:
            return cut_block(docs, Block(docs, side, inside), bits)
        finally:
            give_back()

    kinds = with_row(docs, CUT)
    done = keyed.groupBy("block").cogroup(side.repartition(tasks, "block").groupBy("block")).applyInArrow(cut, kinds)
    if all_alone:
        return done
    # the rows of a text may be very many: they are dealt out by salts, and its result comes to each of them
    done = stored(done.withColumns({"ord": F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST_ID)), "tag": F.xxhash64(F.coalesce("row.text", F.lit(""))), "more": F.xxhash64(F.lit(1), F.coalesce("row.text", F.lit("")))}), "cut")
    alone = done.join(several, key, "left_anti").select("row", *CUT_COLUMNS)
    results = done.join(several, key).select(*key, *CUT_COLUMNS, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    rows = given.join(several, key, "left_semi").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    return alone.unionByName(rows.join(results, [*key, "salt"]).select("row", *CUT_COLUMNS))


def remove_repeats(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """docs with ``kept`` (binary: the bytes left), ``n_bytes`` (of the text) and ``spans`` (removed: array<struct<start, end>>)."""
    if clash := [c for c in docs.columns if c.lower() in ("kept", "n_bytes", "spans")]:
        raise ValueError(f"columns of the input clash with those made here: {clash}")
    return cut_docs(docs, frequent).select("row.*", "kept", "n_bytes", "spans")


def suffix_digest(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of docs: what was removed, and a checksum of what is left."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut_docs(docs.select("doc_id", "text"), frequent).select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs with their texts cut; characters that lose some of their bytes go whole (U+FFFD where a text has that already)."""
    whole = F.make_valid_utf8(F.col("kept").cast("string"))
    odd = F.lit("\ufffd")
    text = F.when(F.col("row.text").isNotNull(), F.when(F.contains("row.text", odd), whole).otherwise(F.replace(whole, odd, F.lit(""))))
    given = [text.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return cut_docs(docs).select(*given)
