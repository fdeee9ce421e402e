"""A bounded sample of labelled texts for fitting, and small helpers of the fitted models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, keep=None, n_chars: bool = False) -> tuple[list[str], list[float | None], np.ndarray, float]:
    """At most ``per_class`` rows of each class 0 and 1: texts, their n_chars, labels, and the share of 1 among all labelled rows.

    Rows are those with the smallest hashed doc_id, so a sample depends on ids alone. Null labels and ids
    take no part; a doc_id labelled both ways counts as 0; of rows of one doc_id the smallest text counts. ``keep``: a
    condition on doc_id. n_chars are null unless ``n_chars``, which says that docs have that column.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if keep is not None:
        known = known.where(keep)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    if share is None:
        return [], [], np.zeros(0), 0.5
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    length = F.col("n_chars").cast("double") if n_chars else F.lit(None).cast("double")
    rows = (  # at most 2 * per_class rows are broadcast and collected
        docs.select("doc_id", F.struct(F.coalesce("text", F.lit("")).alias("text"), length.alias("n_chars")).alias("d"))
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.min("d").alias("d"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .select("d.text", "d.n_chars", "y")
        .collect()
    )
    return [r["text"] for r in rows], [r["n_chars"] for r in rows], np.array([r["y"] for r in rows], float), float(share)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def calibrate(logit: np.ndarray, y: np.ndarray, share: float, rounds: int = 50) -> tuple[float, float]:
    """Platt scaling (a, b) of probabilities sigmoid(a * logit + b), classes weighted to ``share``; b bounded by ridge."""
    ones = max(y.mean(), 1e-6) if len(y) else 0.5
    weight = np.where(y == 1, share / ones, (1 - share) / max(1 - ones, 1e-6))
    target = np.where(y == 1, 1 - 1e-3, 1e-3)
    a, b = 1.0, 0.0
    x = np.stack([logit, np.ones_like(logit)])
    for _ in range(rounds):
        p = sigmoid(a * logit + b)
        grad = x @ (weight * (p - target)) + 1e-3 * np.array([a - 1, b])
        hess = (x * (weight * p * (1 - p))) @ x.T + np.diag([1e-3, 1e-3])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3)), float(b)
