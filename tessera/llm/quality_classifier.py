"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

For features x the logit is w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): all pairwise
interactions, of rank ``RANK``, in time linear in the features (the sum-of-squares identity). Features are
the shares of hashed lower-cased words, standardised statistics of the text's structure, and the metadata
column ``n_chars`` where it is given. Labels, lang, source and doc_id are never features. The model is fitted
on a bounded sample of labelled rows (``per_class``) and calibrated on a quarter of it that the fit doesn't see.

Defined cases: a null text counts as empty, and an empty text gets the score of its statistics alone; null or
missing ``n_chars`` counts as the text's own length; repeated rows are scored each; without labelled rows
of both classes every score is the share of label 1 (0.5 without any label); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessera.llm.arrays import SCORED_BYTES, SPACE, Texts, hash_runs, lower_ascii, mix, per_text, place_of_text, runs, text_slices, texts_of
from tessera.llm.labelled import calibrate, labelled_sample, sigmoid
from tessera.llm.tables import in_arrow, whole_row, with_row

BITS, RANK = 15, 8
UPPER, DIGIT, MARK, SYMBOL = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = True
DIGIT[48:58] = True
MARK[[ord(c) for c in ".,;:!?'\"()-"]] = True
SYMBOL[[ord(c) for c in "#*$%&|<>@^_=+~{}[]\\/"]] = True
N_STATS = 12


@dataclass(frozen=True)
class FactorModel:
    """Weights and factors of the words' buckets and, after them, of the statistics; their centre and spread; the calibration."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    scale: tuple[float, float]


def describe(t: Texts, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as (text, bucket, share), one entry for each text and bucket, and the statistics of each text."""
    data, offsets = t.data, t.offsets
    words = runs(~SPACE[data], offsets)
    hashed = hash_runs(lower_ascii(data), words.start, words.end)
    pair, times = np.unique((words.doc << BITS) | (hashed >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    doc = pair >> BITS
    n_words = np.diff(words.first)
    share = times / np.maximum(n_words, 1)[doc]
    size = np.diff(offsets)

    def part(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[data])])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)

    lines = runs(data != 10, offsets)
    line_key = mix(hash_runs(data, lines.start, lines.end) + lines.doc.astype(np.uint64))
    again = np.ones(len(line_key), bool)
    again[np.unique(line_key, return_index=True)[1]] = False
    n_lines = np.bincount(lines.doc, minlength=t.n)
    distinct = np.bincount(doc, minlength=t.n)
    last = data[np.maximum(words.end - 1, 0)] if len(words.end) else data[:0]
    stats = np.stack(
        [
            np.log1p(size),
            np.log1p(n_words),
            per_text((words.end - words.start).astype(float), words.first) / np.maximum(n_words, 1) / 10,
            part(UPPER),
            part(DIGIT),
            part(MARK),
            part(SYMBOL),
            per_text(SYMBOL[last].astype(float), words.first) / np.maximum(n_words, 1),
            np.bincount(lines.doc[again], minlength=t.n) / np.maximum(n_lines, 1),
            n_words / np.maximum(n_lines, 1) / 100,
            distinct / np.maximum(n_words, 1),
            np.log1p(np.maximum(n_chars, 0)) - np.log1p(size),
        ],
        1,
    )
    return doc, pair & ((1 << BITS) - 1), share, stats


def raw_scores(doc: np.ndarray, bucket: np.ndarray, share: np.ndarray, stats: np.ndarray, m: FactorModel) -> np.ndarray:
    """The logit before calibration, by the sum-of-squares identity."""
    first = np.searchsorted(doc, np.arange(len(stats) + 1))
    x = (stats - m.centre) / m.spread
    w, v = m.linear[: 1 << BITS], m.factors[: 1 << BITS]
    ws, vs = m.linear[1 << BITS :], m.factors[1 << BITS :]
    out = m.bias + per_text(w[bucket] * share, first) + x @ ws
    for f in range(RANK):
        vx = v[bucket, f] * share
        total = per_text(vx, first) + x @ vs[:, f]
        out += 0.5 * (total**2 - per_text(vx * vx, first) - (x * x) @ (vs[:, f] ** 2))
    return out


def fit(texts: list[str], n_chars: np.ndarray, y: np.ndarray, share_of_ones: float, rounds: int = 80, rate: float = 0.05, seed: int = 7) -> FactorModel | None:
    """Fit by Adam on whole gradients of the class-balanced log loss. None without both classes."""
    if not 0 < y.sum() < len(y):
        return None
    parts = [(t.lo, *describe(t, n_chars[t.lo : t.hi])) for t in text_slices(pa.array(texts))]
    doc = np.concatenate([lo + d for lo, d, *_ in parts])
    bucket, share, stats = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
    unseen = np.arange(len(y)) % 4 == 3
    seen = ~unseen if 0 < y[~unseen].sum() < (~unseen).sum() and unseen.any() else np.ones(len(y), bool)
    centre, spread = stats[seen].mean(0), stats[seen].std(0) + 1e-3
    size = (1 << BITS) + N_STATS
    rng = np.random.default_rng(seed)
    linear, factors, bias = np.zeros(size), rng.normal(0, 0.05, (size, RANK)), 0.0
    all_doc = np.concatenate([doc, np.repeat(np.arange(len(y)), N_STATS)])
    order = np.argsort(all_doc, kind="stable")
    x = np.clip((stats - centre) / spread, -5, 5)
    row = all_doc[order]
    col = np.concatenate([bucket, np.tile(np.arange(N_STATS) + (1 << BITS), len(y))])[order]
    val = np.concatenate([share, x.ravel()])[order]
    weight = np.where(y == 1, 0.5 / y[seen].mean(), 0.5 / (1 - y[seen].mean())) * seen / seen.sum()
    moments = [np.zeros(1 + size + size * RANK) for _ in range(2)]

    def forward() -> tuple[np.ndarray, np.ndarray]:
        sums = np.stack([np.bincount(row, factors[col, f] * val, len(y)) for f in range(RANK)], 1)
        squares = np.bincount(row, (factors[col] ** 2).sum(1) * val * val, len(y))
        return bias + np.bincount(row, linear[col] * val, len(y)) + 0.5 * ((sums**2).sum(1) - squares), sums

    for step in range(1, rounds + 1):
        z, sums = forward()
        error = weight * (sigmoid(z) - y)
        each = error[row] * val
        grads = [np.array([error.sum()]), np.bincount(col, each, size) + 1e-6 * linear]
        by_factor = [np.bincount(col, each * (sums[row, f] - factors[col, f] * val), size) for f in range(RANK)]
        grad = np.concatenate([*grads, (np.stack(by_factor, 1) + 1e-5 * factors).ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad * grad
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-6)
        bias -= move[0]
        linear -= move[1 : 1 + size] * np.where(np.arange(size) < 1 << BITS, 10, 1)
        factors -= move[1 + size :].reshape(size, RANK)
    apart = unseen if 0 < y[unseen].sum() < unseen.sum() else np.ones(len(y), bool)
    z = forward()[0]
    return FactorModel(float(bias), linear, factors, centre, spread, calibrate(z[apart], y[apart], share_of_ones))


def held_out(folds: int = 5):
    """True where crc32 of doc_id as text is divisible by ``folds``; a null id counts as text ''."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % folds == 0


def fit_classifier(docs: DataFrame, labels: DataFrame, per_class: int = 1000, label: str = "quality", keep=None) -> tuple[FactorModel | None, float]:
    """The model, fitted on at most ``per_class`` labelled rows of each class that meet ``keep``, and the share of 1."""
    texts, given, y, share = labelled_sample(docs, labels, label, per_class, keep, has_length(docs))
    n_chars = np.array([len(x) if n is None or n != n else n for x, n in zip(texts, given)], float)
    return fit(texts, n_chars, y, share), share


def has_length(docs: DataFrame) -> bool:
    """Is there a column of numbers n_chars?"""
    return any(f.name.lower() == "n_chars" and isinstance(f.dataType, NumericType) for f in docs.schema)


def score_classifier(docs: DataFrame, model: tuple[FactorModel | None, float], whole: bool = False) -> DataFrame:
    """One row per row of docs: its doc_id (or all its columns, as the struct ``row``) and ``score``, the calibrated probability of label 1."""
    fitted, share = model
    length = F.length(F.coalesce("text", F.lit("")))
    n_chars = (F.coalesce(F.nullif(F.col("n_chars").cast("double"), F.lit(float("nan"))), length) if has_length(docs) else length).cast("double").alias("n_chars")
    sources = docs.select(whole_row(docs), n_chars) if whole else docs.select("doc_id", "text", n_chars)
    inside = place_of_text(docs.columns) if whole else None
    carry = sources.columns[0]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            chars = batch.column(batch.num_columns - 1).to_numpy()
            for t in text_slices(texts_of(batch, inside), SCORED_BYTES):
                if fitted is None:
                    score = np.full(t.n, share)
                else:
                    doc, bucket, tf, stats = describe(t, chars[t.lo : t.hi])
                    stats = fitted.centre + np.clip((stats - fitted.centre) / fitted.spread, -5, 5) * fitted.spread
                    score = sigmoid(fitted.scale[0] * raw_scores(doc, bucket, tf, stats, fitted) + fitted.scale[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.n), pa.array(score)], names=[carry, "score"])

    kinds = with_row(docs, "score double") if whole else f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    return in_arrow(sources, batches, kinds)


def classify_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs, learnt from rows that aren't held out."""
    model = fit_classifier(docs, labels, per_class, keep=~held_out())
    return score_classifier(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_predicted_good(docs: DataFrame, labels: DataFrame, per_class: int = 1000, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with their own columns, whatever their names."""
    model = fit_classifier(docs, labels, per_class)
    return score_classifier(docs, model, True).where(F.col("score") >= threshold).select("row.*")
