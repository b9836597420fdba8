"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

1. Codes: unit vectors, less their mean, are projected on their principal directions and rotated so that the signs
   lose least (iterative quantisation); up to 64 signs make a code. Fitted on a sample of at most ``SAMPLE`` rows
   (those whose ids hash lowest); every usable row is then coded and indexed.
2. Index: rows are dealt into blocks of ``BLOCK_ROWS``. A block cuts its codes into substrings of 16 bits
   and keeps, for each, the rows sorted by substring and a directory of the substrings that occur.
3. Probing: two codes within Hamming radius r = m * a + b (m substrings, b < m) agree to within a in one of the first
   b + 1 substrings or to within a - 1 in one of the others. A query thus reads the buckets within that many
   flips and gets every code of the block within its radius; the codes decide, and the original vectors of what
   is left are compared in double precision.
4. Radius: the first round takes ``FIRST_RADIUS``. What it found, and the sample, bound the cosine of the
   query's last neighbour from below; the radius that holds nearly all pairs of at least that cosine, learned
   from all pairs of the sample, is what the second round asks for. Queries whose first radius was enough don't
   enter it, so close neighbours cost few probes, and only queries without close ones read much.

Queries stream past the blocks: a task holds one block, its index and one batch of queries, never all queries.
Each query goes to every block (its vector, code and radius), each block returns its best ``k``. Rows that repeat a vector are
spread over the blocks like all others, and no bucket is cut.

Defined results: vectors that are null, empty, zero, or hold null or non-finite entries take no part, nor do those whose
length differs from the most frequent one. Rows with the query's id are not its candidates; if an id that is asked for
occurs more than once, each of its rows is a query of its own. Ties go to the smaller id, null ids last.
With fewer candidates than ``k`` the second round takes all. An empty table gives an empty result. Components are scaled
by a power of two where squares would overflow. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textops import partitions, written
from .vectors import dimension, matrix, whole

SAMPLE = 4096
BLOCK_ROWS = 1 << 17
BITS = 64
SUBSTRING = 16
FIRST_RADIUS = 11
#: Share of the pairs of a given cosine that a radius must hold.
HELD = 0.98
_BIN = 0.02
_FLIPS = np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint16))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows as doubles, scaled by a power of two so that their largest entry lies in [0.5, 1)."""
    v = v.astype(np.float64)
    _, power = np.frexp(np.abs(v).max(axis=1, initial=0.0))
    return np.ldexp(v, -power[:, None])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


@dataclass
class Coder:
    """Mean, rotation (d x bits) and, by bins of cosine, the radius that holds nearly all such pairs."""

    mean: np.ndarray
    rotation: np.ndarray
    radii: np.ndarray
    sample: np.ndarray
    sample_ids: np.ndarray

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def codes(self, units: np.ndarray) -> np.ndarray:
        signs = (units - self.mean) @ self.rotation > 0
        return (signs.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def radius(self, cosine: np.ndarray) -> np.ndarray:
        """The least radius that holds nearly all rows of at least this cosine; all bits where nothing is known."""
        at = np.clip(np.floor((cosine + 1) / _BIN), 0, len(self.radii) - 1).astype(int)
        return np.where(np.isfinite(cosine), self.radii[at], self.bits)


def fit(sample: np.ndarray, ids: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 11) -> Coder:
    u = unit(sample)
    seen = np.unique(u, axis=0)  # repeated vectors say nothing about the rotation
    mean = seen.mean(axis=0)
    bits = min(bits, u.shape[1])
    _, directions = np.linalg.eigh((seen - mean).T @ (seen - mean))
    directions = directions[:, ::-1][:, :bits]
    z = (seen - mean) @ directions
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):  # iterative quantisation: best signs for the rotation, best rotation for the signs
        a, _, b = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
        turn = (a @ b).T
    coder = Coder(mean, directions @ turn, np.zeros(0), u, ids)
    coder.radii = _radii(seen, coder.codes(seen), bits)
    return coder


def _radii(u: np.ndarray, codes: np.ndarray, bits: int) -> np.ndarray:
    """By bin of cosine: the ``HELD`` quantile of the Hamming distance, falling with the cosine."""
    n_bins = int(round(2 / _BIN)) + 1
    counts = np.zeros((n_bins, bits + 1), np.int64)
    for k in range(0, len(u), 256):
        cosine = np.clip(u[k : k + 256] @ u.T, -1, 1)
        apart = np.bitwise_count(codes[k : k + 256, None] ^ codes[None, :])
        off = np.arange(len(u))[None, :] != np.arange(k, k + len(cosine))[:, None]
        cells = np.floor((cosine + 1) / _BIN).astype(np.int64) * (bits + 1) + apart
        counts += np.bincount(cells[off], minlength=counts.size).reshape(counts.shape)
    share = np.arccos(np.clip(-1 + _BIN * np.arange(n_bins), -1, 1)) / np.pi  # how often random hyperplanes part such a pair
    drawn = np.ceil(bits * share + 2.1 * np.sqrt(bits * share * (1 - share)))
    total = counts.sum(axis=1)
    measured = (np.cumsum(counts, axis=1) >= HELD * total[:, None]).argmax(axis=1)
    radius = np.where(total >= 200, measured, np.minimum(drawn, bits)).astype(np.int64)
    return np.maximum.accumulate(radius[::-1])[::-1]


class Block:
    """The multi-index of one block of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, bits: int):
        self.ids, self.vectors, self.codes = ids, scaled(vectors), codes
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.tables = []
        self.m = -(-bits // SUBSTRING)
        for t in range(self.m):
            sub = self.substring(codes, t)
            order = np.argsort(sub, kind="stable")
            values, first = np.unique(sub[order], return_index=True)
            self.tables.append((order, values, np.append(first, len(sub))))
        self.found = np.zeros(len(codes), bool)

    @staticmethod
    def substring(codes, t: int):
        return ((codes >> np.uint64(t * SUBSTRING)) & np.uint64((1 << SUBSTRING) - 1)).astype(np.uint16)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose code is at most ``radius`` flips away, by pigeonhole over the substrings."""
        flips, more = divmod(radius, self.m)
        out = []
        for t, (order, values, first) in enumerate(self.tables):
            allowed = flips if t <= more else flips - 1
            if allowed < 0:
                continue
            hit = np.flatnonzero(_FLIPS[values ^ self.substring(code, t)] <= allowed)
            length = first[hit + 1] - first[hit]
            ends = np.cumsum(length)
            if len(ends):
                rows = order[np.arange(ends[-1]) + np.repeat(first[hit] - (ends - length), length)]
                rows = rows[~self.found[rows]]
                self.found[rows] = True
                out.append(rows)
        rows = np.concatenate(out) if out else np.zeros(0, np.int64)
        self.found[rows] = False
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]

    def best(self, own: int, vector: np.ndarray, code: np.uint64, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and cosines of the k nearest of the codes within the radius."""
        rows = self.within(code, radius)
        rows = rows[self.ids[rows] != own]
        cosine = (self.vectors[rows] * vector).sum(axis=1) / (self.norms[rows] * np.sqrt((vector * vector).sum()))
        if len(rows) > k:
            near = cosine >= np.partition(cosine, len(rows) - k)[len(rows) - k]  # with all ties
            rows, cosine = rows[near], cosine[near]
        order = np.lexsort((self.ids[rows], -cosine))[:k]
        return rows[order], cosine[order]


#: Stands for a null id inside the arrays, where ids are longs.
NULL_ID = np.iinfo(np.int64).max


def coded(rows: DataFrame, coder: Coder, width: int) -> DataFrame:
    """Adds ``code`` and ``sampled``, the k-th best cosine among the sample (a lower bound; null where it has fewer than k)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = coder.codes(unit(matrix(b.column("v"), width)))
                yield b.append_column("code", pa.array(codes.view(np.int64)))

    return rows.mapInArrow(work, "id long, v {}, code long".format(rows.schema["v"].dataType.simpleString()))


def sample_bound(coder: Coder, width: int, k: int):
    """Of Arrow ids and vectors: the k-th best cosine among the sample without the row's own id, minus infinity without one."""
    def bound(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        cosine = unit(vectors) @ coder.sample.T
        cosine[ids[:, None] == coder.sample_ids[None, :]] = -np.inf
        if cosine.shape[1] < k:
            return np.full(len(ids), -np.inf)
        return np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]

    return bound


def searched(index: DataFrame, queries: DataFrame, n_blocks: int, width: int, bits: int, k: int) -> DataFrame:
    """(query, query_id, id, score): of each query (query, query_id, v, code, radius) the best k of every block."""
    element = index.schema["v"].dataType.simpleString()
    rows = index.select("block", F.lit(None).cast("long").alias("query"), "id", "v", "code", F.lit(0).alias("radius"))
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "query", F.col("query_id").alias("id"), "v", "code", "radius")
    dealt = rows.unionByName(asked).repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", F.col("query").asc_nulls_first())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None
        for b in batches:
            number = b.column("query")
            n_rows = number.null_count  # rows come before queries
            if n_rows:
                held.append(b.slice(0, n_rows))
            b = b.slice(n_rows)
            if not b.num_rows or not (held or block):
                continue
            if held:
                all_ids = [_ids(h) for h in held]
                block = Block(np.concatenate(all_ids), np.concatenate([matrix(h.column("v"), width) for h in held]),
                              np.concatenate([_codes(h) for h in held]), bits)
                held = []
            found = [[], [], [], []]
            v = scaled(matrix(b.column("v"), width))
            for q, own, vector, code, radius in zip(b.column("query").to_numpy(), _ids(b), v, _codes(b), b.column("radius").to_numpy()):
                near, cosine = block.best(own, vector, code, int(radius), k)
                found[0].append(np.full(len(near), q))
                found[1].append(np.full(len(near), own))
                found[2].append(block.ids[near])
                found[3].append(cosine)
            q, own, ids, score = [np.concatenate(x) for x in found]
            yield pa.record_batch([pa.array(q, pa.int64()), pa.array(own, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(score, pa.float64())],
                                  ["query", "query_id", "id", "score"])

    return dealt.select("query", "id", "v", "code", "radius").mapInArrow(work, "query long, query_id long, id long, score double")


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return b.column("id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _codes(b: pa.RecordBatch) -> np.ndarray:
    return b.column("code").to_numpy(zero_copy_only=False).view(np.uint64)


def neighbours(table: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, sample: int = SAMPLE,
               block_rows: int = BLOCK_ROWS, first_radius: int = FIRST_RADIUS) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of every row for which ``asked`` holds, among all other rows."""
    spark = table.sparkSession
    schema = "query_id long, rank int, id long, score double"
    usable = table.where(whole(vector) & F.exists(vector, lambda c: c != 0))
    width = dimension(usable, vector)
    if not width:
        return spark.createDataFrame([], schema)
    rows = usable.where(F.size(vector) == width).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), asked.alias("asked"))
    drawn = rows.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(sample).select("id", "v").toArrow()
    ids = drawn.column("id").fill_null(NULL_ID).to_numpy()
    coder = fit(matrix(drawn.column("v"), width), ids)

    index = written(coded(rows.select("id", "v"), coder, width), "mih-codes")
    n_rows = index.count()
    n_blocks = max(-(-n_rows // block_rows), min(partitions(spark), -(-n_rows // 4096)))
    index = index.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks)).cast("int"))

    bound = sample_bound(coder, width, k)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v"), width)
                yield b.append_column("code", pa.array(coder.codes(unit(v)).view(np.int64))).append_column("sampled", pa.array(bound(_ids(b), v)))

    element = rows.schema["v"].dataType.simpleString()
    queries = written(rows.where("asked").select("id", "v").mapInArrow(prepare, f"id long, v {element}, code long, sampled double"), "mih-queries")
    queries = written(queries.select(F.monotonically_increasing_id().alias("query"), F.col("id").alias("query_id"), "v", "code", "sampled"), "mih-queries")

    first = written(searched(index, queries.withColumn("radius", F.lit(min(first_radius, coder.bits))), n_blocks, width, coder.bits, k), "mih-first")
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    last = first.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") == k).select("query", F.col("score").alias("last"))
    radii = F.array(*[F.lit(int(r)) for r in coder.radii])
    known = F.greatest(F.col("sampled"), F.coalesce("last", F.lit(float("-inf"))))
    wide = F.when(known > -2, F.get(radii, F.least(F.greatest(F.floor((known + 1) / _BIN), F.lit(0)), F.lit(len(coder.radii) - 1)).cast("int"))).otherwise(coder.bits)
    again = queries.join(last, "query", "left").withColumn("radius", wide.cast("int")).where(F.col("radius") > first_radius)
    again = written(again.drop("sampled", "last"), "mih-again")
    second = searched(index, again, n_blocks, width, coder.bits, k)
    kept = first.join(again.select("query"), "query", "left_anti").unionByName(second)
    return kept.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
