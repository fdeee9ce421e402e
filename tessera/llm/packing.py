"""Packing: documents as token pieces, packed into fixed windows by non-negative least squares.

A document's ids are cut at multiples of the window; the rest of each document is a piece of its own. Piece
lengths are counted in a histogram of at most ``FINE + window / STEP`` bins. All combinations of up to three
lengths that fill the window exactly are enumerated, their repeat counts are solved against the histogram by
non-negative least squares, rounded and cut to what is there, and the residual is packed greedily (longest
first, then the longest that still fits). That plan depends on the histogram alone and is small at every
size of the input; pieces find their place in it by their rank within their bin.

Defined cases: a null or empty text is the end id alone; repeated rows and null ids are packed as rows of their
own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrays import Known, spread, text_batches
from tessera.llm.tables import in_arrow, stored

WINDOW = 2048
STEP = 16  #: lengths from FINE up are rounded up to multiples of this
FINE = 64  #: shorter pieces are binned by their exact length
END_ID = 1
SLICE_BYTES = 1 << 19
MARK = "<|endoftext|>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that stay single letters in lower case and in NFC.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
#: What a tokenizer file has to say for its ids to be those of the stretches between ASCII white space, in
#: order, where a stretch of letters and then punctuation is two parts and letters count by their lower case.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_at_spaces(tokenizer_path: str) -> bool:
    """Does the tokenizer drop white space, and split letters from punctuation, as ``Stretches`` takes it to?"""
    with open(tokenizer_path, encoding="utf-8") as f:
        made = json.load(f)
    first = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    split = first.get("type") == "Split" and first.get("pattern") == {"Regex": SPLIT_PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
    specials = [t["content"] for t in made.get("added_tokens", [])]
    return made.get("normalizer") == NORMALIZER and split and made["model"].get("end_of_word_suffix") == "</w>" and MARK in specials and not any(c.isspace() for t in specials for c in t)


class Whole:
    """Ids of whole texts, for any tokenizer."""

    def __init__(self, tokenizer_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by the end id, and where each text ends."""
        got = [np.append(self.encode(t), np.uint32(END_ID)) for t in texts.to_pylist()]
        return np.concatenate(got), np.cumsum([len(x) for x in got])


class Stretches(Whole):
    """Ids of texts by their stretches between white space; frequent stretches and parts are remembered.

    Most stretches are letters and then punctuation. The tokenizer splits there, so such a stretch is two parts, and
    letters are remembered by their lower case. Flat ids of all parts lie in ``flat``, ``ends`` says where each ends;
    a stretch is a first and a second part (part 0 is the empty one). What is remembered is bounded (``Known``).
    """

    def __init__(self, tokenizer_path: str) -> None:
        super().__init__(tokenizer_path)
        self.mark = self.tokenizer.token_to_id(MARK)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        self.stretches, self.parts = Known(), Known()
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.first, self.second = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn_parts(self, words: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The new parts' numbers. words: letters only, each of which ends with a token that closes a word; others: anything."""
        ids, sizes = [self.flat], [np.diff(self.ends, prepend=0)]
        for k in range(0, len(words), 512):
            got = self.encode(" ".join(words.slice(k, 512).to_pylist()))
            ids.append(got)
            sizes.append(np.diff(np.flatnonzero(self.closes[got]), prepend=-1))
        held = pc.match_substring(others, MARK).to_numpy(zero_copy_only=False)
        order = np.argsort(held, kind="stable")
        others, n_plain = others.take(pa.array(order)), int((~held).sum())
        for k in range(0, n_plain, 512):  # a special token ends a part as the end of a text does
            got = self.encode(MARK.join(others.slice(k, min(512, n_plain - k)).to_pylist()))
            at = np.flatnonzero(got == self.mark)
            ids.append(got[got != self.mark])
            sizes.append(np.diff(np.concatenate([[-1], at, [len(got)]])) - 1)
        for one in others.slice(n_plain).to_pylist():
            ids.append(self.encode(one))
            sizes.append(np.array([len(ids[-1])]))
        base = len(self.ends)
        self.flat, self.ends = np.concatenate(ids), np.cumsum(np.concatenate(sizes))
        self.parts.add(pa.concat_arrays([words, others]))
        numbers = np.empty(len(others), np.int64)
        numbers[order] = base + len(words) + np.arange(len(others))
        return base + np.arange(len(words)), numbers

    def learn(self, new: pa.Array) -> None:
        letters = pc.utf8_rtrim(new, characters=PUNCTUATION)
        wordlike = pc.match_substring_regex(letters, LETTERS)
        tails = [x[n:] for x, n in zip(new.to_pylist(), pc.utf8_length(letters).to_pylist())]
        front = pc.if_else(wordlike, pc.utf8_lower(letters), pa.scalar("", pa.large_string()))
        back = pc.if_else(wordlike, pa.array(tails, pa.large_string()), new)
        both = pa.concat_arrays([front, back]).dictionary_encode()
        number = self.parts.find(both.dictionary)
        unknown = np.flatnonzero(number < 0)
        words = pc.is_in(both.dictionary.take(pa.array(unknown)), value_set=front).to_numpy(zero_copy_only=False)
        number[unknown[words]], number[unknown[~words]] = self.learn_parts(*(both.dictionary.take(pa.array(unknown[x])) for x in (words, ~words)))
        first, second = number[both.indices.to_numpy(zero_copy_only=False)].reshape(2, -1)
        self.first, self.second = np.append(self.first, first), np.append(self.second, second)
        self.stretches.add(new)

    def forget(self) -> None:
        """Only frequent stretches and their parts stay, if too many are remembered."""
        if not (self.stretches.full or self.parts.full):
            return
        on = self.stretches.often()
        used, where = np.unique(np.concatenate([[0], self.first[on], self.second[on]]), return_inverse=True)
        self.first, self.second = where[1 : len(on) + 1], where[len(on) + 1 :]
        sizes = np.diff(self.ends, prepend=0)
        begin = (self.ends - sizes)[used]
        self.flat = self.flat[spread(begin, sizes[used])]
        self.ends = np.cumsum(sizes[used])
        self.parts.strings, self.parts.uses = self.parts.strings.take(pa.array(used)), np.zeros(len(used), np.int64)
        self.stretches.strings, self.stretches.uses = self.stretches.strings.take(pa.array(on)), self.stretches.uses[on] // 2

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        words = split.flatten()
        self.forget()
        codes = self.stretches.find(words)
        unknown = np.flatnonzero(codes < 0)
        if len(unknown):
            missed = words.take(pa.array(unknown)).dictionary_encode()
            base = len(self.stretches.strings)
            self.learn(missed.dictionary)
            codes[unknown] = base + missed.indices.to_numpy(zero_copy_only=False)
        self.stretches.uses += np.bincount(codes, minlength=len(self.stretches.uses))
        parts = np.stack([self.first[codes], self.second[codes]], 1).ravel()
        sizes = np.diff(self.ends, prepend=0)
        size = sizes[parts]
        total = np.cumsum(size)
        stops = np.concatenate([[0], total])[2 * np.cumsum(n)]  # where each text's own ids end
        ends = stops + np.arange(1, len(n) + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, END_ID, np.uint32)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = self.flat[spread((self.ends - sizes)[parts], size)]
        return out, ends


WORKER: dict[str, Whole] = {}  #: of one tokenizer at most


def encoder(tokenizer_path: str) -> Whole:
    """This worker's encoder, kept over its tasks."""
    if tokenizer_path not in WORKER:
        WORKER.clear()
        WORKER[tokenizer_path] = Stretches(tokenizer_path) if splits_at_spaces(tokenizer_path) else Whole(tokenizer_path)
    return WORKER[tokenizer_path]


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids."""
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in it:
            for lo, texts in text_batches(batch.column(1), SLICE_BYTES):
                ids, ends = own.ids(texts)
                begins = np.concatenate([[0], ends[:-1]])
                n = -(-(ends - begins) // window)
                doc = np.repeat(np.arange(len(texts)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
                at = begins[doc] + start
                length = np.minimum(ends[doc] - at, window)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a : a + size]) for a, size in zip(at.tolist(), length.tolist())]
                columns = [batch.column(0).take(pa.array(doc + lo)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array((ends - begins)[doc])]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, ends[-1]), pa.int32()), pa.array(raw.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return in_arrow(docs.select("doc_id", "text"), batches, kinds)


def rounded(length: int, fine: int = FINE, step: int = STEP) -> int:
    """The bin of a length: itself if short, else the next multiple of the step."""
    return length if length < fine else -(-length // step) * step


def combinations(sizes: list[int], window: int) -> list[tuple[int, ...]]:
    """All ways to fill the window with one to three of the sizes."""
    have, out = set(sizes), [(window,)] if window in sizes else []
    for a in sizes:
        if a * 2 <= window and window - a in have:
            out.append((a, window - a))
        for b in sizes:
            c = window - a - b
            if a <= b <= c and c in have:
                out.append((a, b, c))
    return out


def nonnegative_least_squares(a: np.ndarray, goal: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that brings a @ x nearest to goal: the active-set method on the normal equations."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    small = 1e-9 * max(1.0, float(np.abs(a.T @ goal).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (goal - a[:, active] @ x[active])
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= small:
            break
        active[best] = True
        while True:
            which = np.flatnonzero(active)
            part = a[:, which]
            solved = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(which)), part.T @ goal)
            if (solved > 0).all():
                x[:] = 0
                x[which] = solved
                break
            old, low = x[which], solved <= 0
            share = np.min(old[low] / np.maximum(old[low] - solved[low], 1e-300))
            x[which] = np.maximum(old + share * (solved - old), 0)
            drop = which[low & (x[which] <= 1e-12)]
            drop = drop if len(drop) else which[low][:1]
            active[drop] = False
            x[drop] = 0
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (how many of each size) and how often each is used; together they use the histogram up exactly."""
    left = Counter({size: n for size, n in histogram.items() if n})
    large = sorted(size for size in left if size >= FINE)
    patterns: list[tuple[dict[int, int], int]] = []
    ways = combinations(large, window)
    if ways:
        row = {size: k for k, size in enumerate(large)}
        a = np.zeros((len(large), len(ways)))
        for k, way in enumerate(ways):
            for s in way:
                a[row[s], k] += 1
        weights = np.sqrt(np.array(large) / window)  # long pieces are the hardest to place later
        x = nonnegative_least_squares(a * weights[:, None], weights * np.array([left[s] for s in large], float))
        for k in np.argsort(-x, kind="stable"):
            need = Counter(ways[k])
            times = min(round(float(x[k])), *(left[s] // m for s, m in need.items()))
            if times > 0:
                patterns.append((dict(need), times))
                left.subtract({s: m * times for s, m in need.items()})
    while left := +left:  # the residual: longest first, then the longest that still fits
        gap, need = window, Counter()
        for size in sorted(left, reverse=True):
            if take := min(left[size], gap // size):
                need[size] = take
                gap -= take * size
        times = min(left[s] // m for s, m in need.items())
        patterns.append((dict(need), times))
        left.subtract({s: m * times for s, m in need.items()})
    return patterns


def pack_pieces(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces with ``sequence_id`` and ``offset``; pieces must read the same each time (a written table)."""
    spark = pieces.sparkSession
    size = F.when(F.col("length") < FINE, F.col("length")).otherwise(F.ceil(F.col("length") / STEP) * STEP).cast("int")
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    binned = pieces.withColumn("_bin", size).withColumn("_block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)).cast("int"))
    counted = binned.groupBy("_bin", "_block").agg(F.count("*").alias("_n"))
    histogram = {r["_bin"]: r["n"] for r in counted.groupBy("_bin").agg(F.sum("_n").alias("n")).collect()}  # at most FINE + window / STEP rows
    places, next_rank, sequence = [], Counter(), 0
    for need, times in plan(histogram, window):
        slot = 0
        for s, m in sorted(need.items(), reverse=True):
            lo = next_rank[s]
            places.append((s, lo, lo + m * times, m, sequence, slot))
            next_rank[s] += m * times
            slot += m
        sequence += times
    before = Window.partitionBy("_bin").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("_bin", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bin", "_block").orderBy("doc_id", "start", "ids_crc32")
    ranked = binned.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["_bin", "_block"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # a row for each size of each pattern of the plan, which the bins bound
    table = spark.createDataFrame(places, "_size int, _lo long, _hi long, _times long, _first long, _slot long")
    placed = ranked.join(F.broadcast(table), (F.col("_bin") == F.col("_size")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    nth = F.col("_rank") - F.col("_lo")
    placed = placed.withColumn("sequence_id", F.col("_first") + F.floor(nth / F.col("_times"))).withColumn("_slot", F.col("_slot") + nth % F.col("_times"))
    earlier = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*pieces.columns, "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Every token of docs in exactly one piece, every piece in one sequence of at most ``window`` tokens.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, (ids). Pieces are tokenized once, and
    written to the shared folder before they are counted; ids don't go through the counting, but join its result.
    """
    made = token_pieces(docs, tokenizer_path, window, keep_ids)
    if not keep_ids:
        return pack_pieces(stored(made, "pieces"), window)
    pieces = stored(made.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    placed = pack_pieces(pieces.drop("ids"), window)
    return placed.join(pieces.select("_piece", "ids"), "_piece").drop("_piece")
