"""Embedding whitening by weighted multiplicity covariance.

Vectors become integer vectors x = floor(1024 * entry) + 100000. Identical x are one class, whose weight is
its number of rows (or one, by parameter), combined before the shuffle, so one vector that a third of all
rows share is one row from there on. Everything heavy runs over classes:

1. Exact integer sums S and the total weight n.
2. The covariance, centred before multiplying: each task adds up its d x d matrix of weighted products of
   (n * x - S) / n, whose numerators are exact integers; Spark adds the tasks' cells up.
3. The eigenvectors of that d x d matrix are taken on the driver; its size depends on the dimension alone.
4. Each class is projected once. The whitened rows are joined back to the rows' ids by a 128-bit digest of x;
   classes of more than a ``HOT``-th of all rows, of which there are at most ``HOT``, are broadcast, so no task
   gets all rows of a frequent vector.

Defined results: vectors that are null, empty, or hold null or non-finite entries are dropped, as are those whose
length differs from the most frequent one (of equally frequent lengths the longest counts). Every other row counts, also
with a null or repeated id. 1024 times an entry is clamped to +-9e18, so that x fits a long; a ``deviation`` of more than 38 digits is
null. Components
without variance (eigenvalue at most d * 2**-52 of the largest) have null ``whitened`` and are left out of
``identity_error``; with no variance at all ``explained`` and ``identity_error`` are null too. Fewer than 8 dimensions
give as many components. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import written
from .vectors import dimension, lists, matrix, whole

HOT = 1000
SCHEMA = "id {id}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def scaled_entries(vector: str) -> Column:
    def one(c: Column) -> Column:
        return F.floor(F.least(F.greatest(c.cast("double") * 1024, F.lit(-9e18)), F.lit(9e18))) + 100_000

    return F.transform(vector, one)


def digest(x: str) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", F.transform(x, lambda v: v.cast("string")))))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in 64 bits where they hold it, else in Python's integers."""
    largest = max([abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), 1])
    if n * largest + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def square_sums(d: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows of an integer matrix."""
    if d.dtype == object or int(np.abs(d).max(initial=0)) >= 1 << 52:
        return [sum(int(v) * int(v) for v in row) for row in d]
    high, low = d >> 26, d & ((1 << 26) - 1)  # 26 bits each: sums of their products stay far below 2**63
    parts = zip((high * high).sum(1).tolist(), (high * low).sum(1).tolist(), (low * low).sum(1).tolist())
    return [(a << 52) + (b << 27) + c for a, b, c in parts]


def totals(classes: DataFrame, width: int) -> tuple[int, list[int]]:
    """Total weight and exact weighted sums of the dimensions."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width + 1, object)
        for b in batches:
            x, w = matrix(b.column("x"), width), b.column("weight").to_numpy()
            sums[width] += int(w.sum())
            if max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * int(w.sum()) < 1 << 62:
                sums[:width] += (x * w[:, None]).sum(0).astype(object)
            else:
                sums[:width] += (x.astype(object) * w[:, None]).sum(0)
        yield pa.record_batch([pa.array(range(width + 1), pa.int32()), pa.array([Decimal(int(v)) for v in sums], pa.decimal128(38, 0))], ["at", "s"])

    found = classes.select("x", "weight").mapInArrow(part, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()
    sums = [0] * (width + 1)
    for r in found:
        sums[r["at"]] = int(r["s"])
    return sums[width], sums[:width]


def covariance(classes: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    width = len(sums)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            c = centred(matrix(b.column("x"), width), n, sums).astype(np.float64) / n
            total += (c * b.column("weight").to_numpy()[:, None]).T @ c
        yield pa.record_batch([pa.array(np.arange(width * width, dtype=np.int32)), pa.array(total.reshape(-1))], ["cell", "v"])

    cells = classes.select("x", "weight").mapInArrow(part, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width * width)
    for r in cells:
        out[r["cell"]] = r["v"]
    return out.reshape(width, width) / n


def identity_error(whitened: DataFrame, usable: list[int], n: int) -> float | None:
    """Largest absolute entry of the whitened classes' weighted covariance minus the identity."""
    if not usable:
        return None
    z = {k: F.col("z")[k] for k in usable}
    means = whitened.agg(*[(F.sum(F.col("weight") * z[k]) / n).alias(f"m{k}") for k in usable]).first()
    apart = {k: z[k] - F.lit(means[f"m{k}"]) for k in usable}
    pairs = [(j, k) for j in usable for k in usable if j <= k]
    cells = whitened.agg(*[(F.sum(F.col("weight") * apart[j] * apart[k]) / n).alias(f"c{j}_{k}") for j, k in pairs]).first()
    return max(abs(cells[f"c{j}_{k}"] - (j == k)) for j, k in pairs)


def whitened(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8, weights: str = "counts") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    ``weights``: 'counts' fits on all rows, 'one' on every distinct x once.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights: counts or one")
    spark = table.sparkSession
    schema = SCHEMA.format(id=table.schema[key].dataType.simpleString())
    rows = table.where(whole(vector)).select(F.col(key).alias("id"), scaled_entries(vector).alias("x"))
    ids = written(rows.select("id", F.size("x").alias("width"), digest("x").alias("digest")), "whiten-ids")
    counts = rows.groupBy("x").agg(F.count(F.lit(1)).alias("rows"))
    weight = F.col("rows") if weights == "counts" else F.lit(1).cast("long")
    classes = written(counts.select("x", "rows", weight.alias("weight"), digest("x").alias("digest")), "whiten-classes")
    width = dimension(classes, "x", F.col("rows"))
    if not width:
        return spark.createDataFrame([], schema)
    classes = classes.where(F.size("x") == width)
    n, sums = totals(classes, width)
    cov = covariance(classes, n, sums)
    values, vectors = np.linalg.eigh(cov)
    falling = np.argsort(-values, kind="stable")[: min(components, width)]
    e, trace = values[falling], float(np.trace(cov))
    usable = [k for k in range(len(e)) if e[k] > max(width * 2.0**-52 * values.max(), 0.0)]
    scale = np.full(len(e), np.nan)
    scale[usable] = 1 / np.sqrt(e[usable])
    projection = np.where(np.isnan(scale), 0.0, vectors[:, falling] * np.nan_to_num(scale))
    none = np.isnan(scale)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = centred(matrix(b.column("x"), width), n, sums)
            z = (d.astype(np.float64) / n) @ projection
            z[:, none] = np.nan
            deviation = pa.array([Decimal(v) if v < 10**38 else None for v in square_sums(d)], pa.decimal128(38, 0))
            yield pa.record_batch([b.column("digest"), b.column("rows"), b.column("weight"), deviation, lists(z)], ["digest", "rows", "weight", "deviation", "z"])

    done = written(classes.mapInArrow(project, "digest binary, rows long, weight long, deviation decimal(38,0), z array<double>"), "whitened")
    error = identity_error(done, usable, n)
    total = done.agg(F.sum("rows")).first()[0]

    ids = ids.where(F.col("width") == width).select("id", "digest")
    hot = done.where(F.col("rows") * HOT > total).select("digest", "deviation", "z")
    cold = done.where(F.col("rows") * HOT <= total).select("digest", "deviation", "z")
    joined = ids.join(F.broadcast(hot), "digest").unionByName(
        ids.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest"))
    explained = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in e])
    out = joined.select("id", "deviation", F.posexplode("z").alias("k", "whitened"))
    return out.select(
        "id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
