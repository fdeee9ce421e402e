"""SentencePiece encoding and decoding: sampled segmentations of the piece lattice.

A text's spaces become the space mark, one mark goes before it, and it is cut before every run of marks; no piece
crosses such a cut, so the lattice of a text is that of its stretches, one after the other. In each stretch forward
weights are summed over all segmentations (a piece weighs exp(theta * score); a character that no single piece
spells can be spelt in bytes), and a segmentation is sampled backwards, from the end, in proportion to its weight. Random
numbers come from the seed, the row's key, the stretch's number and the step, so a row gets the same
segmentation in every run and partitioning. Decoding gives back the text exactly.

Defined cases: a null or empty text has no pieces; rows of equal keys and texts get equal pieces; a key that isn't an
integer counts by its hash, a null key as key 0; a space mark inside a text is spelt in bytes; an empty table gives an empty result; extra columns are ignored. A stretch
without spaces is one lattice, so that it has to fit in a task's memory (some 200 bytes a character).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm.arrays import Known, mix, powers, spread, text_batches
from tessera.llm.tables import in_arrow

MARK = "▁"
LITERAL = 0xD800  #: the code point that stands for a space mark in a text; no text holds a lone surrogate
KNOWN_EDGES = 1 << 21  #: of lattices that a worker remembers, 12 bytes each
LEARN_CHARS = 1 << 17  #: of stretches whose lattices are made at a time
SAMPLE_STRETCHES = 1 << 16  #: that are sampled at a time
BYTE_WEIGHT = -30.0  #: log weight of a byte piece
SLICE_BYTES = 1 << 19


class Pieces:
    """The pieces of a model, and what they spell."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        text = [model.id_to_piece(k) for k in range(n)]
        self.byte = {int(text[k][3:5], 16): k for k in range(n) if model.is_byte(k)}
        plain = [k for k in range(n) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
        if crossing := [text[k] for k in plain if MARK in text[k].lstrip(MARK)]:
            raise ValueError(f"pieces of the model cross a space: {crossing[:3]}")
        self.id = {text[k]: k for k in plain}
        # scores are minus the rank of the merge; pieces with none (the lowest score) count as the last rank
        low = min(s for k in plain if (s := model.get_score(k)) > -1e8)
        self.score = np.array([max(model.get_score(k), low) for k in self.id.values()])
        raw = [bytes([int(text[k][3:5], 16)]) if model.is_byte(k) else text[k].replace(MARK, " ").encode() if text[k] in self.id else b"" for k in range(n)]
        self.raw_size = np.array([len(x) for x in raw])
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def decoded(self, pieces: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The texts that pieces spell, without the first mark."""
        size = self.raw_size[pieces]
        data = self.raw[spread(self.raw_start[pieces], size)].tobytes()
        stop = np.concatenate([[0], np.cumsum(size)])[ends]
        start = np.concatenate([[0], stop[:-1]])
        return [data[a + 1 : b] if b > a else b"" for a, b in zip(start.tolist(), stop.tolist())]


def stretches_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The stretches of texts (all spaces but the first, then what follows them), and the number of them before each text.

    A text of n spaces has n + 1 items between them, empty ones where spaces meet; a stretch ends with an item
    that isn't empty, or with its text.
    """
    split = pc.split_pattern(texts, pattern=" ")
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    n[pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0] = 0
    items = pc.list_flatten(split.filter(pa.array(n > 0)))
    before = np.concatenate([[0], np.cumsum(n)])
    ends = pc.binary_length(items).to_numpy(zero_copy_only=False) > 0
    ends[before[1:][n > 0] - 1] = True
    at = np.flatnonzero(ends)
    first = np.searchsorted(at, before)
    spaces = np.diff(at, prepend=-1) - 1  # no stretch reaches into the text before, as the last item of a text ends one
    words = items.take(pa.array(at))
    odd = np.flatnonzero(spaces)
    if len(odd):
        longer = [" " * k + w for k, w in zip(spaces[odd].tolist(), words.take(pa.array(odd)).to_pylist())]
        words = pc.replace_with_mask(words, pa.array(spaces > 0), pa.array(longer, pa.large_string()))
    return words, first


class Lattices:
    """Lattices of stretches, remembered within bounds: for each place of a stretch the pieces that end there, with their chances.

    A stretch has one place more than characters. ``first`` has the edges before each place; an edge is its chance among
    those of its place (running sum), its piece, and how many places it leads back.
    """

    def __init__(self, model_path: str, theta: float) -> None:
        self.pieces = Pieces(model_path)
        texts = list(self.pieces.id)
        self.longest = max(map(len, texts))
        sizes = np.array([len(x) for x in texts])
        points = code_points("".join(texts))
        ends = np.cumsum(sizes)
        keys = substring_keys(points, ends - sizes, sizes)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(self.pieces.id.values()))[order]
        self.weights = theta * self.pieces.score[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(keys & np.uint64(len(self.seen) - 1)).astype(np.int64)] = True
        self.stretches = Known()
        self.n_places = np.zeros(1, np.int64)  # of each stretch; the empty string, number 0, is a single mark
        self.first = np.zeros(1, np.int64)
        self.chance, self.piece, self.back = np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.learn(pa.array([""], pa.large_string()))

    def find(self, stretches: pa.Array) -> np.ndarray:
        """The numbers of stretches; lattices of new ones are made."""
        once = stretches.dictionary_encode()
        number = self.stretches.find(once.dictionary)
        new = np.flatnonzero(number < 0)
        if len(new):
            missed = once.dictionary.take(pa.array(new))
            number[new] = len(self.stretches.strings) + np.arange(len(new))
            chars = np.cumsum(pc.utf8_length(missed).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            cuts = np.unique(np.searchsorted(chars, np.arange(LEARN_CHARS, int(chars[-1]) + LEARN_CHARS, LEARN_CHARS), "right"))
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(new)]):
                if hi > lo:
                    self.learn(missed.slice(lo, hi - lo))
            self.stretches.add(missed)
        out = number[once.indices.to_numpy(zero_copy_only=False)]
        self.stretches.uses += np.bincount(out, minlength=len(self.stretches.uses))
        return out

    def forget(self) -> None:
        """Only frequent stretches stay, if too much is remembered."""
        if not (self.stretches.full or len(self.piece) > KNOWN_EDGES):
            return
        on = self.stretches.often()
        places = spread((np.cumsum(self.n_places) - self.n_places)[on], self.n_places[on])
        n = np.diff(self.first)[places]
        while n.sum() > KNOWN_EDGES // 2:  # the less used half goes
            on = np.sort(on[1:][np.argsort(-self.stretches.uses[on[1:]], kind="stable")[: (len(on) - 1) // 2]])
            on = np.append(0, on)
            places = spread((np.cumsum(self.n_places) - self.n_places)[on], self.n_places[on])
            n = np.diff(self.first)[places]
        edges = spread(self.first[places], n)
        self.chance, self.piece, self.back = self.chance[edges], self.piece[edges], self.back[edges]
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.n_places = self.n_places[on]
        self.stretches.strings, self.stretches.uses = self.stretches.strings.take(pa.array(on)), self.stretches.uses[on] // 2

    def learn(self, new: pa.Array) -> None:
        """Lattices of new stretches, each a space and its string: edges, ordered by the place they end at."""
        points = code_points(" " + " ".join(new.to_pylist()))
        sizes = pc.utf8_length(new).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        points = np.where(points == ord(MARK), LITERAL, np.where(points == 32, ord(MARK), points)).astype(np.uint32)
        ends = np.cumsum(sizes)
        stretch = np.repeat(np.arange(len(sizes)), sizes)
        n = np.arange(len(points))
        left = ends[stretch] - n  # characters to the end of the stretch
        place = n + stretch  # of the front of each character; each stretch has one place more than characters
        places = len(points) + len(new)
        begin, end, piece, weight = [], [], [], []
        for size in range(1, self.longest + 1):
            at = np.flatnonzero(left >= size)
            key = substring_keys(points, at, size)
            maybe = self.seen[(key & np.uint64(len(self.seen) - 1)).astype(np.int64)]
            at, key = at[maybe], key[maybe]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            same = self.keys[found] == key
            at, found = at[same], found[same]
            begin.append(place[at])
            end.append(place[at] + size)
            piece.append(self.ids[found])
            weight.append(self.weights[found])
        reached = np.zeros(places + 1, bool)
        reached[np.concatenate(end)] = True
        bare = np.flatnonzero(~reached[place + 1])  # no piece ends behind this character: spell it in bytes
        utf8 = 1 + (points[bare] > 0x7F) + (points[bare] > 0x7FF) + (points[bare] > 0xFFFF)
        begin, end = np.concatenate([*begin, place[bare]]), np.concatenate([*end, place[bare] + 1])
        piece = np.concatenate([*piece, -2 - points[bare].astype(np.int64)])
        weight = np.concatenate([*weight, BYTE_WEIGHT * utf8])
        depth = np.zeros(places + 1, np.int64)
        depth[place + 1] = sizes[stretch] - left + 1
        order = np.lexsort((begin, end, depth[end]))
        begin, end, piece, weight = begin[order], end[order], piece[order], weight[order]
        steps = np.searchsorted(depth[end], np.arange(1, int(sizes.max()) + 2))
        total = np.zeros(places + 1)
        for lo, hi in zip(steps[:-1].tolist(), steps[1:].tolist()):  # all stretches at once, one character further each time
            to = end[lo:hi]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            value = total[begin[lo:hi]] + weight[lo:hi]
            top = np.maximum.reduceat(value, first)
            whole = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(first, hi - lo)))), first)
            total[to[first]] = top + np.log(whole)
        order = np.lexsort((begin, end))
        begin, end, piece, weight = begin[order], end[order], piece[order], weight[order]
        value = np.exp(total[begin] + weight - total[end])
        first = np.searchsorted(end, np.arange(places + 1))
        n = np.diff(first)
        for k in range(1, int(n.max())):  # running sums within each place, the same whatever is learnt beside it
            more = first[:-1][n > k] + k
            value[more] += value[more - 1]
        value[first[1:][n > 0] - 1] = 1.0
        self.first = np.concatenate([self.first, len(self.piece) + first[1:]]) if len(self.first) > 1 else first
        self.chance = np.concatenate([self.chance, value.astype(np.float32)])
        self.piece = np.concatenate([self.piece, piece.astype(np.int32)])
        self.back = np.concatenate([self.back, (end - begin).astype(np.int32)])
        self.n_places = np.concatenate([self.n_places, sizes + 1]) if self.n_places[0] else sizes + 1

    def sample(self, texts: pa.Array, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts, and where each text ends."""
        self.forget()
        stretches, before = stretches_of(texts)
        row = np.repeat(np.arange(len(texts)), np.diff(before))
        number = np.arange(len(stretches)) - before[row]
        stream = mix(mix(keys[row].astype(np.uint64) ^ np.uint64(seed)) + number.astype(np.uint64))
        pieces, count = [np.zeros(0, np.int32)], np.zeros(len(stretches), np.int64)
        for lo in range(0, len(stretches), SAMPLE_STRETCHES):
            some = slice(lo, lo + SAMPLE_STRETCHES)
            taken, count[some] = self.walked(self.find(stretches[some]), stream[some])
            pieces.append(taken)
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum(count)])[before[1:]]

    def walked(self, known: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled pieces of known stretches from random streams, and how many each stretch has."""
        at = (np.cumsum(self.n_places) - 1)[known]
        which, taken, depth = [], [], []
        alive = np.arange(len(at))
        step = 0
        while len(alive):
            u = ((mix(stream[alive] + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(40)).astype(np.float32)) / np.float32(1 << 24)
            edge = self.first[at[alive]]
            behind = np.arange(len(edge))
            while len(behind := behind[self.chance[edge[behind]] <= u[behind]]):  # the last edge of a place has chance 1
                edge[behind] += 1
            which.append(alive)
            taken.append(self.piece[edge])
            depth.append(np.full(len(alive), step))
            at[alive] -= self.back[edge]
            step += 1
            alive = alive[self.first[at[alive] + 1] > self.first[at[alive]]]  # the start of a stretch has no edges
        which, taken, depth = np.concatenate(which), np.concatenate(taken), np.concatenate(depth)
        count = np.bincount(which, minlength=len(at))
        ordered = np.empty_like(taken)
        ordered[(np.cumsum(count) - 1)[which] - depth] = taken  # pieces were taken from the end
        odd = np.flatnonzero(ordered < 0)
        if not len(odd):
            return ordered, count
        # characters without a piece are spelt in bytes
        spelling = {c: [self.pieces.byte[x] for x in (MARK if -2 - c == LITERAL else chr(-2 - c)).encode()] for c in set(ordered[odd].tolist())}
        size = np.ones(len(ordered), np.int64)
        size[odd] = [len(spelling[c]) for c in ordered[odd].tolist()]
        out = np.repeat(ordered, size)
        begin = np.cumsum(size) - size
        out[spread(begin[odd], size[odd])] = [x for c in ordered[odd].tolist() for x in spelling[c]]
        return out, np.bincount(np.repeat(np.arange(len(count)), count), size, len(count)).astype(np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)


def substring_keys(points: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    """64-bit hashes of points[start : start + size], the same wherever a substring stands."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(len(points), BASE), dtype=np.uint64)])
    return mix((sums[start + size] - sums[start]) * powers(len(points) + 1, INVERSE)[start] + np.asarray(size).astype(np.uint64))


WORKER: dict[tuple, Lattices | Pieces] = {}  #: of one model at most


def remembered(kind: type, *of) -> Lattices | Pieces:
    """This worker's lattices or pieces, kept over its tasks."""
    if (kind, *of) not in WORKER:
        WORKER.clear()
        WORKER[kind, *of] = kind(*of)
    return WORKER[kind, *of]


def encode(docs: DataFrame, model_path: str, theta: float = 1e-3, seed: int = 1) -> DataFrame:
    """doc_id and ``pieces``, the ids of a sampled segmentation, for every row of docs."""
    kind = docs.schema["doc_id"].dataType
    key = F.col("doc_id").cast("long") if isinstance(kind, IntegralType) else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = remembered(Lattices, model_path, theta)
        for batch in it:
            keys = batch.column(2).to_numpy()
            for lo, texts in text_batches(batch.column(1), SLICE_BYTES):
                pieces, ends = own.sample(texts, keys[lo : lo + len(texts)], seed)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(pieces, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), lists], names=["doc_id", "pieces"])

    return in_arrow(docs.select("doc_id", "text", F.coalesce(key, F.lit(0)).alias("key")), batches, f"doc_id {kind.simpleString()}, pieces array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, pieces and ``text``, what the pieces spell; null pieces spell ''."""
    key = encoded.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = remembered(Pieces, model_path)
        for batch in it:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                lists = part.column(1).fill_null([])
                ends = np.cumsum(lists.value_lengths().to_numpy())
                texts = own.decoded(lists.flatten().to_numpy(), ends)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "pieces", "text"])

    return in_arrow(encoded.select("doc_id", "pieces"), batches, f"doc_id {key}, pieces array<int>, text string")
