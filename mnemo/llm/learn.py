"""What both classifiers share: folds, the bounded sample of labelled rows, and logistic regression in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import written


def held_out(key: str, folds: int, which: int) -> Column:
    """Is crc32 of the id as text in the given fold? (null for null ids)"""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == which


def labelled_sample(docs: DataFrame, known: DataFrame, rows: int, key: str = "doc_id", text: str = "text", seed: int = 5) -> DataFrame:
    """At most ``rows`` labelled texts, written: those whose ids hash lowest, whatever the input's size.

    ``known`` (key, label) is cut to ``rows`` ids by a top-k, so it may be broadcast; one row an id, with its
    largest label. Of documents that repeat an id the least text counts (null before all).
    """
    picked = known.groupBy(key).agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(rows)
    picked = written(picked, "labelled")
    found = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(picked), key)
    return written(found.groupBy(key).agg(F.min(F.struct("text", "label")).alias("row")).select(key, "row.*"), "sample")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(product, transposed, y: np.ndarray, width: int, l1: float = 0.0, l2: float = 0.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by accelerated proximal gradient.

    ``product(w)`` and ``transposed(g)`` multiply by the feature matrix and its transpose; the bias is
    not penalised. Penalties are per row of the mean loss.
    """
    n = len(y)
    probe = np.random.Generator(np.random.PCG64(3)).normal(size=width)
    scale = 1.0
    for _ in range(12):  # largest eigenvalue of X'X / n, by power iteration
        probe = transposed(product(probe)) / n
        scale = float(np.linalg.norm(probe)) or 1.0
        probe /= scale
    step = 1 / (0.25 * (scale * 1.1 + 1) + l2)
    rate = float(np.clip(y.mean() if n else 0.5, 0.01, 0.99))
    w, b = np.zeros(width), float(np.log(rate / (1 - rate)))
    at, b_at, t = w, b, 1.0
    for _ in range(rounds):
        g = (sigmoid(product(at) + b_at) - y) / max(n, 1)
        new = at - step * (transposed(g) + l2 * at)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        b_new = b_at - step * float(g.sum())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, b_at = new + (t - 1) / t_new * (new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = new, b_new, t_new
    return w, b
