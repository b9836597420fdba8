"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the byte n-grams (4 to 8, ASCII lower case, white space as one kind of byte) of a whole
text, hashed to ``SLOTS``, present or absent. On a sample of at most ``TRAIN_ROWS`` labelled texts,
the log ratio of each feature's (smoothed) shares among toxic and other texts scales it; of the
``KEPT`` features whose shares differ most surely a logistic regression with L2 penalty is fitted. The
sample and the fit are bounded by these two parameters and run in one task; scoring covers every
text, with a table of ``SLOTS`` weights (4 MB) sent to the tasks.

Null and empty texts have no features: their score is the bias alone. Equal texts score equally.
Without labelled rows, or with one class only, every score is the smoothed share of toxic labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .learn import labelled_sample, logistic, sigmoid
from .textops import blocks, lean, utf8

ORDERS = (4, 5, 6, 7, 8)
SLOTS = 1 << 20
TRAIN_ROWS = 8000
KEPT = 1 << 14
SMOOTHING = 1.0

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD = _FOLD * np.uint32(2654435761) + np.uint32(97)


def features(texts: pa.Array, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every feature present, once each, by row; with ``weight``, only slots whose weight is not 0."""
    raw, offsets = utf8(texts)
    value = _FOLD[raw]
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(raw))  # bytes to the text's end
    acc = np.zeros(len(raw), np.uint32)
    found = []
    for k in range(max(ORDERS)):
        acc[: max(len(raw) - k, 0)] += value[k:] * np.uint32(pow(0x85EBCA6B, k + 1, 1 << 32))
        if k + 1 in ORDERS:
            slot = ((acc ^ (acc >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(12)
            ok = left > k
            if weight is not None:
                ok &= weight[slot] != 0
            at = np.flatnonzero(ok)
            row = np.searchsorted(offsets, at, "right") - 1
            found.append(row.astype(np.int64) * SLOTS + slot[at])
    key = np.unique(np.concatenate(found))
    return key // SLOTS, key % SLOTS


@dataclass
class Model:
    weight: np.ndarray  # by slot, the ratio multiplied in; 0 where not kept
    bias: float


def train(texts: list[str], y: np.ndarray) -> Model:
    weight = np.zeros(SLOTS, np.float32)
    n, n1 = len(y), float(y.sum())
    if n1 == 0 or n1 == n:
        p = (n1 + 1) / (n + 2)
        return Model(weight, float(np.log(p / (1 - p))))
    def each(weight: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        for block in blocks(iter([pa.record_batch({"text": pa.array(texts, pa.string())})])):
            row, slot = features(block.column(0), weight)
            yield row + at, slot
            at += block.num_rows

    pos, neg = np.zeros(SLOTS), np.zeros(SLOTS)
    for row, slot in each():
        toxic = y[row] == 1
        pos += np.bincount(slot[toxic], minlength=SLOTS)
        neg += np.bincount(slot[~toxic], minlength=SLOTS)
    ratio = np.log((pos + SMOOTHING) / (pos + SMOOTHING).sum()) - np.log((neg + SMOOTHING) / (neg + SMOOTHING).sum())
    n0 = n - n1
    share = (pos + neg) / n
    surely = np.abs(pos / n1 - neg / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    surely[pos + neg < 3] = 0
    kept = np.argsort(-surely, kind="stable")[:KEPT]
    kept = kept[surely[kept] > 0]
    number = np.full(SLOTS, -1, np.int64)
    number[kept] = np.arange(len(kept))
    found = list(each((number >= 0).astype(np.float32)))
    row = np.concatenate([r for r, _ in found])
    col = number[np.concatenate([c for _, c in found])]
    value = ratio[kept][col]
    w, bias = logistic(lambda w: np.bincount(row, value * w[col], n), lambda g: np.bincount(col, value * g[row], len(kept)),
                       y.astype(float), len(kept), l2=0.0005)
    weight[kept] = w * ratio[kept]
    return Model(weight, bias)


def fit(docs: DataFrame, known: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> Model:
    """Model from the documents whose key is in ``known`` (key, label 0/1)."""
    sample = labelled_sample(docs, known, rows, key, text)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for b in batches:
            texts += [t or "" for t in b.column("text").to_pylist()]
            y += b.column("label").to_pylist()
        order = sorted(range(len(y)), key=lambda k: (texts[k], y[k]))  # the same sums whatever order the rows come in
        model = train([texts[k] for k in order], np.array(y, np.int64)[order] if order else np.zeros(0, np.int64))
        yield pa.record_batch({"weight": pa.array([model.weight.tobytes()], pa.binary()), "bias": pa.array([model.bias], pa.float64())})

    row = sample.select("text", "label").coalesce(1).mapInArrow(one, "weight binary, bias double").collect()
    return Model(np.frombuffer(row[0].weight, np.float32), row[0].bias) if row else train([], np.zeros(0, np.int64))


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """The rows with their probability of being toxic, in place of the text column."""
    lean(docs.sparkSession)
    names = [f.name for f in docs.schema.fields if f.name not in (text, into)]
    schema = ", ".join([*(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names), f"`{into}` double"])
    sent = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = sent.value
        for b in blocks(batches, text):
            row, slot = features(b.column(text), weight)
            z = np.bincount(row, weight[slot], b.num_rows) + bias
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sigmoid(z))], names=[*names, into])

    return docs.mapInArrow(run, schema)
