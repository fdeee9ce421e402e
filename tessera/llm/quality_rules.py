"""Quality rules: counting rules, then a calibrated logistic regression on hashed word and character n-grams.

The model is fitted on a bounded sample of labelled rows (``per_class``), calibrated by Platt scaling on a
quarter of that sample that the fit doesn't see, and scored in Arrow batches against the fixed threshold
``reject_below``. Words are ``[^\\x20\\x09-\\x0D]+``.

Defined cases: a null text counts as empty; an empty text has no words, so the counting rules reject it;
repeated rows and null ids are scored row by row; without labelled rows of both classes only the counting
rules decide; an empty table gives an empty result; further columns of the input are ignored, and
``reject_low_quality`` gives them back as they were, also those named like columns made here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.arrays import SCORED_BYTES, SPACE, Texts, hash_runs, mix, per_text, place_of_text, runs, text_slices, texts_of, windows
from tessera.llm.labelled import calibrate, labelled_sample, sigmoid
from tessera.llm.tables import give_back, in_arrow, whole_row, with_row

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
BITS = 16  #: of the hashed features of each kind
WORD_NGRAMS, CHAR_NGRAMS = (1, 2), (3, 4)
FITTED_AT_ONCE = 128  #: texts
KINDS = len(WORD_NGRAMS) + len(CHAR_NGRAMS)

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


@dataclass(frozen=True)
class QualityModel:
    """Weights by kind and bucket, a bias, and the calibration (a, b)."""

    weights: np.ndarray
    bias: float
    scale: tuple[float, float]


def repeated(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each value: does its text hold it twice or more?"""
    if not len(values):
        return np.zeros(0, bool)
    key = mix(values + doc.astype(np.uint64))
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(key), bool)
    return twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key


def counts(t: Texts) -> tuple[dict[str, np.ndarray], dict]:
    """The counted columns of each text, and the parts that features are made of."""
    data, offsets = t.data, t.offsets
    word_byte = ~SPACE[data]
    words = runs(word_byte, offsets)
    hashed = hash_runs(data, words.start, words.end)
    begins = (data & 0xC0) != 0x80  # first byte of a code point
    lines = runs(data != 10, offsets)
    full = np.searchsorted(words.start, lines.start) < np.searchsorted(words.start, lines.end)
    start, end, doc = lines.start[full], lines.end[full], lines.doc[full]
    line_key = mix(hash_runs(data, start, end) + doc.astype(np.uint64))
    again = np.ones(len(line_key), bool)
    again[np.unique(line_key, return_index=True)[1]] = False
    three, before = windows(hashed, words.first, 3)
    three_doc = np.repeat(np.arange(t.n), np.diff(before))
    at = np.flatnonzero(repeated(three, three_doc))
    inside = np.zeros(len(hashed) + 3, bool)
    for k in range(3):
        inside[at + (words.first[three_doc[at]] - before[three_doc[at]]) + k] = True
    n_words = np.diff(words.first)
    bounds = np.concatenate([[0], np.cumsum(word_byte & begins)])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    got = {
        "n_words": n_words,
        "word_chars": bounds[offsets[1:]] - bounds[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(doc[again], minlength=t.n),
        "n_repeat_words": per_text(inside[: len(hashed)].astype(np.int64), words.first),
    }
    got["base_failed"] = (n_words < 50) | (100 * got["n_repeat_words"] > 50 * n_words)
    return got, {"words": words, "hashed": hashed}


def feature_sums(t: Texts, parts: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: its number, the buckets, and the occurrences before each text."""
    top = np.uint64(64 - BITS)
    kind = 0
    for n in WORD_NGRAMS:
        grams, before = windows(parts["hashed"], parts["words"].first, n)
        yield kind, (grams >> top).astype(np.int64), before
        kind += 1
    size = np.diff(t.offsets)
    for n in CHAR_NGRAMS:
        each = np.maximum(size - n + 1, 0)
        before = np.concatenate([[0], np.cumsum(each)])
        at = np.arange(before[-1]) + np.repeat(t.offsets[:-1] - before[:-1], each)
        gram = np.zeros(len(at), np.uint32)
        for k in range(n):
            gram = (gram << np.uint32(8)) | t.data[at + k]
        gram *= np.uint32(0x9E3779B1)
        yield kind, (gram >> np.uint32(32 - BITS)).astype(np.int64), before
        kind += 1


def logits(t: Texts, parts: dict, weights: np.ndarray, bias: float) -> np.ndarray:
    """Mean weight of each kind of n-gram, summed."""
    out = np.full(t.n, bias)
    for kind, bucket, before in feature_sums(t, parts):
        out += per_text(weights[kind][bucket].astype(float), before) / np.maximum(np.diff(before), 1)
    return out


def features(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For a few texts and a kind at a time: number of the first, the kind, and by pair of text and bucket: the text's number from there, the bucket, and its share.

    Kept in 16 bytes a pair and never brought together, as this is held on the driver.
    """
    for at in range(0, len(texts), FITTED_AT_ONCE):
        for t in text_slices(pa.array(texts[at : at + FITTED_AT_ONCE])):
            parts = counts(t)[1]
            for kind, bucket, before in feature_sums(t, parts):
                doc = np.repeat(np.arange(t.n), np.diff(before))
                pair, n = np.unique((doc << BITS) | bucket, return_counts=True)
                row = pair >> BITS
                yield at + t.lo, kind, row.astype(np.int32), (pair & ((1 << BITS) - 1)).astype(np.int32), n / np.maximum(np.diff(before), 1)[row]


def fit(texts: list[str], y: np.ndarray, share: float, rounds: int = 80, rate: float = 1.0, l2: float = 1e-6) -> QualityModel | None:
    """Logistic regression on the mean of the n-grams' weights, by Adam on whole gradients. None without both classes."""
    if not 0 < y.sum() < len(y):
        return None
    found = list(features(texts))
    unseen = np.arange(len(y)) % 4 == 3
    seen = ~unseen if 0 < y[~unseen].sum() < (~unseen).sum() and unseen.any() else np.ones(len(y), bool)
    w, bias = np.zeros(KINDS << BITS), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def z() -> np.ndarray:
        out = np.full(len(y), bias)
        for lo, kind, rows, cols, values in found:
            some = np.bincount(rows, w[kind << BITS : (kind + 1) << BITS][cols] * values)
            out[lo : lo + len(some)] += some
        return out

    def gradient(error: np.ndarray) -> np.ndarray:
        out = l2 * w
        for lo, kind, rows, cols, values in found:
            out[kind << BITS : (kind + 1) << BITS] += np.bincount(cols, values * error[lo + rows], 1 << BITS)
        return out

    for step in range(1, rounds + 1):
        error = np.where(seen, sigmoid(z()) - y, 0) / seen.sum()
        grad = np.append(gradient(error), error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
        w, bias = w - move[:-1], bias - move[-1] * 0.1
    apart = unseen if 0 < y[unseen].sum() < unseen.sum() else np.ones(len(y), bool)
    return QualityModel(w.reshape(KINDS, -1).astype(np.float32), float(bias), calibrate(z()[apart], y[apart], share))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1000, label: str = "quality") -> QualityModel | None:
    """Fit on at most ``per_class`` labelled rows of each class."""
    texts, _, y, share = labelled_sample(docs, labels, label, per_class)
    model = fit(texts, y, share)
    give_back()
    return model


def score_quality(docs: DataFrame, model: QualityModel | None, reject_below: float = 0.2, whole: bool = False) -> DataFrame:
    """One row per row of docs: its doc_id (or all its columns, as the struct ``row``), the counts, ``quality`` and ``kept``.

    ``quality`` is the calibrated probability of label 1 (null without a model); a row is kept unless the
    counting rules fail or quality is under ``reject_below``.
    """
    inside = place_of_text(docs.columns) if whole else None

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for t in text_slices(texts_of(batch, inside), SCORED_BYTES):
                got, parts = counts(t)
                fine = ~got["base_failed"]
                if model is None:
                    got["quality"] = pa.nulls(t.n, pa.float64())
                else:
                    p = sigmoid(model.scale[0] * logits(t, parts, model.weights, model.bias) + model.scale[1])
                    got["quality"] = p
                    fine &= p >= reject_below
                got["kept"] = fine
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.n), *(pa.array(x) for x in got.values())], names=["row" if whole else "doc_id", *got])

    if whole:
        return in_arrow(docs.select(whole_row(docs)), batches, with_row(docs, COLUMNS))
    return in_arrow(docs.select("doc_id", "text"), batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def quality_rules(docs: DataFrame, labels: DataFrame, per_class: int = 1000, reject_below: float = 0.2) -> DataFrame:
    """Fit on docs and labels, then score and judge every row of docs."""
    return score_quality(docs, fit_quality(docs, labels, per_class), reject_below)


def reject_low_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1000, reject_below: float = 0.2) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns, whatever their names."""
    return score_quality(docs, fit_quality(docs, labels, per_class), reject_below, True).where("kept").select("row.*")
