"""Quality classifier: a sparse rule ensemble, compiled into Spark column expressions.

Statistics of every whole text are computed in Arrow batches. On a sample of at most ``TRAIN_ROWS``
labelled texts, shallow trees are grown on the statistics (random halves of rows and columns); every
path from a root is a conjunctive rule. A lasso logistic regression weighs the rules, most weights become
zero, and the rest is one Spark expression over the statistics' columns, so scoring needs no model
object. Sample, trees and rules are bounded by the parameters below.

Null and empty texts have all statistics 0 and are scored as any other. Equal texts score equally.
Without labelled rows or with one class every score is the smoothed share of good labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learn import labelled_sample, logistic
from .textops import _U, blocks, lean, mix, shingles, words

TRAIN_ROWS = 8000
TREES = 24
DEPTH = 3
CUTS = 24
LASSO = 0.0008

STATISTICS = ("words", "bytes_per_word", "symbols_per_word", "digits", "capitals", "marks", "words_per_line", "other_bytes",
              "distinct_words", "distinct_windows", "longest_word", "commonest_word")

_KIND = np.zeros((256, 6), np.int64)
for _k, _chars in enumerate((b"#*$%&|<>", b"0123456789", bytes(range(65, 91)), b".,;:!?", b"\n", bytes(range(128, 256)))):
    _KIND[list(_chars), _k] = 1


def _distinct(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By row: how many values differ, and how often the commonest occurs."""
    key, at, count = np.unique(mix(values ^ mix(row.astype(_U) + _U(1))), return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, row[at], count)
    return np.bincount(row[at], minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` a text."""
    w = words(texts)
    n, count, row = len(w.first) - 1, w.per_row, w.row()
    size = np.diff(w.offsets)
    kinds = np.zeros((n, _KIND.shape[1]))
    for k in range(_KIND.shape[1]):
        total = np.append(0, np.cumsum(_KIND[:, k][w.raw]))
        kinds[:, k] = total[w.offsets[1:]] - total[w.offsets[:-1]]
    length = w.end - w.start
    inside = np.bincount(row, length, n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, length)
    distinct, most = _distinct(w.hash, row, n)
    windows, bounds = shingles(w, 3)
    m = np.diff(bounds)
    distinct_windows, _ = _distinct(windows, np.repeat(np.arange(n), m), n)
    each, per = np.maximum(count, 1), np.maximum(size, 1)
    symbols, digits, capitals, marks, lines, other = kinds.T
    return np.stack([count, inside / each, symbols / each, digits / per, capitals / per, marks / each, count / (lines + 1), other / per,
                     distinct / each, distinct_windows / np.maximum(m, 1), longest, most / each], axis=1).astype(float)


def with_statistics(docs: DataFrame, text: str = "text", into: str = "statistics") -> DataFrame:
    """The rows with one struct column of the statistics in place of the text column."""
    lean(docs.sparkSession)
    names = [f.name for f in docs.schema.fields if f.name != text]
    fields = ", ".join(f"{s}: double" for s in STATISTICS)
    schema = ", ".join([*(f"`{x}` {docs.schema[x].dataType.simpleString()}" for x in names), f"`{into}` struct<{fields}>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text):
            made = pa.StructArray.from_arrays([pa.array(c) for c in statistics(b.column(text)).T], names=list(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), made], names=[*names, into])

    return docs.mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, cut): above means > cut, else <= cut


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, path: Rule = ()) -> Iterator[Rule]:
    """The paths of one tree: at each node the best cut, by Gini, among a random half of the statistics."""
    if path:
        yield path
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return
    best = (1e-6, -1, 0.0)
    whole = len(y) * y.mean() * (1 - y.mean())
    for k in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]:
        for cut in np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")):
            low = x[:, k] <= cut
            a = int(low.sum())
            if 5 <= a <= len(y) - 5:
                p, q = y[low].mean(), y[~low].mean()
                gain = whole - a * p * (1 - p) - (len(y) - a) * q * (1 - q)
                if gain > best[0]:
                    best = (gain, int(k), float(cut))
    _, k, cut = best
    if k >= 0:
        low = x[:, k] <= cut
        yield from grow(x[low], y[low], rng, depth - 1, (*path, (k, False, cut)))
        yield from grow(x[~low], y[~low], rng, depth - 1, (*path, (k, True, cut)))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) == above
    return out


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> tuple[list[tuple[Rule, float]], float]:
    """Rules with their weights, and the bias."""
    n = len(y)
    if n == 0 or y.min() == y.max():
        p = (float(y.sum()) + 1) / (n + 2)
        return [], float(np.log(p / (1 - p)))
    rng = np.random.Generator(np.random.PCG64(seed))
    rules: dict[bytes, Rule] = {}
    for _ in range(TREES):
        part = rng.permutation(n)[: max(min(n, 200), n // 2)]
        for rule in grow(x[part], y[part].astype(float), rng, DEPTH):
            on = holds(rule, x)
            if 0 < on.sum() < n:
                rules.setdefault(np.packbits(on).tobytes(), rule)  # rules that hold for the same rows are one
    matrix = np.stack([holds(r, x) for r in rules.values()], axis=1).astype(float)
    w, bias = logistic(lambda v: matrix @ v, lambda g: matrix.T @ g, y.astype(float), matrix.shape[1], l1=LASSO, rounds=400)
    return [(r, float(v)) for r, v in zip(rules.values(), w, strict=True) if abs(v) > 1e-3], bias


def fit(docs: DataFrame, known: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> tuple[list[tuple[Rule, float]], float]:
    sample = labelled_sample(docs, known, rows, key, text)
    got = with_statistics(sample.select("label", "text")).select("label", "statistics.*").toPandas()  # at most ``rows`` rows of a few numbers
    got = got.sort_values(list(got.columns)).reset_index(drop=True)
    return train(got[list(STATISTICS)].to_numpy(float), got["label"].to_numpy(int))


def expression(model: tuple[list[tuple[Rule, float]], float], of: str = "statistics") -> Column:
    """The model as a Spark expression over the struct column of statistics."""
    rules, bias = model
    z = F.lit(bias)
    for rule, weight in rules:
        cond = F.lit(True)
        for k, above, cut in rule:
            c = F.col(f"`{of}`.{STATISTICS[k]}")
            cond = cond & ((c > cut) if above else (c <= cut))
        z = z + F.when(cond, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def scored(docs: DataFrame, model: tuple[list[tuple[Rule, float]], float], text: str = "text", into: str = "score") -> DataFrame:
    """The rows with the probability of good quality, in place of the text column; a column called ``into`` is replaced."""
    at = "statistics"
    while at in docs.columns or at == into:
        at += "_"
    return with_statistics(docs.drop(into) if into != text else docs, text, at).withColumn(into, expression(model, at)).drop(at)
