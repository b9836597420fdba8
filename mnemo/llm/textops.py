"""Vectorised word and shingle helpers shared by the operators of this subpackage.

All work on Arrow string columns inside Spark tasks. A word is ``[^\\x20\\x09-\\x0D]+``; the
separators are ASCII, so words are cut on UTF-8 bytes without decoding. Word hashes add up 64-bit
hashes of each byte with its place in the word (so no pattern of letters cancels out), then mixed;
shingle hashes combine the mixed word hashes.

Nulls count as empty texts. Work arrays are a few dozen bytes per byte of text, so batches are cut
into blocks of ``BLOCK_BYTES`` (one longer document is a block of its own, never cut).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

BLOCK_BYTES = 1 << 20

_U = np.uint64
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a word are hashed with their place in it; up to this place by table.
_PLACES = 64
_LETTERS = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public splitmix64 constants)."""
    x = np.asarray(x)
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix((np.arange(_PLACES * 256, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15))


def _byte_hashes(raw: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash for each byte and its place."""
    out = _BYTES[(np.minimum(place, _PLACES - 1) << np.int32(8)) | raw]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        out[far] = mix(((place[far].astype(_U) << _U(8)) + raw[far].astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = column.buffers()[2] if n else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of ``text`` (a longer text is alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            end = max(at + 1, end)
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()  # workers live on after a task


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The groups of rows with equal whole-number ``keys`` in a stream sorted by them; one group is held at a time."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(k[:, lo].tolist())
            if held and now != last:
                yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(b.slice(lo, hi - lo))
            last = now
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@dataclass
class Words:
    """Words of a block: byte ranges, hashes, and ``first[d]:first[d + 1]`` as the words of row d."""

    raw: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_row)


def words(column: pa.Array, lower: bool = False) -> Words:
    raw, offsets = utf8(column)
    n = len(raw)
    inside = ~_SEPARATORS[raw]
    previous = np.empty(n, bool)
    previous[:1] = False
    previous[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    previous[heads] = False  # a word never goes on into the next document
    start = np.flatnonzero(inside & ~previous)
    following = np.empty(n, bool)
    following[-1:] = False
    following[:-1] = inside[1:]
    following[offsets[1:][(offsets[1:] > 0) & (offsets[1:] <= n)] - 1] = False
    end = np.flatnonzero(inside & ~following) + 1
    hashes = np.empty(len(start), _U)
    ends = np.cumsum(end - start)
    at = 0
    while at < len(start):  # a bounded number of letters at a time
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _LETTERS, "right")))
        length = end[at:upto] - start[at:upto]
        first = np.cumsum(length) - length
        place = np.arange(int(length.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), length)
        letters = raw[np.repeat(start[at:upto].astype(np.int32), length) + place] if n < 1 << 31 else raw[np.repeat(start[at:upto], length) + place]
        hashes[at:upto] = np.add.reduceat(_byte_hashes(_LOWER[letters] if lower else letters, place), first) + length.astype(_U)
        at = upto
    hashes = mix(hashes)
    return Words(raw, offsets, start, end, hashes, np.searchsorted(start, offsets))


_STEP = 0xD6E8FEB86659FD93


def shingles(w: Words, n: int, value: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Hashes of the n-word shingles of every row and their row bounds; with ``value`` by word, also its sums by shingle.

    A row with fewer words than n has its whole sequence as one shingle; a row without words none.
    Repeated shingles stay.
    """
    h, count = w.hash, w.per_row
    m = np.maximum(len(h) - n + 1, 0)
    acc = np.zeros(m, _U)
    for k in range(n):
        acc += h[k : k + m] * _U(pow(_STEP, k, 1 << 64))
    many = np.maximum(count - n + 1, 0)
    keep = np.zeros(len(h) + 1, np.int64)
    long = count >= n
    np.add.at(keep, w.first[:-1][long], 1)
    np.add.at(keep, (w.first[:-1] + many)[long], -1)
    where = np.flatnonzero(np.cumsum(keep[:-1])[:m])
    out = mix(acc[where] + _U(n))
    sums = None
    if value is not None:
        sums = np.zeros(len(where), value.dtype)
        for k in range(n):
            sums += value[where + k]
    short = np.flatnonzero((count > 0) & (count < n))
    if not len(short):
        bounds = np.concatenate([[0], np.cumsum(many)])
        return (out, bounds) if value is None else (out, bounds, sums)
    each = np.where(count >= n, many, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(each)])
    full = np.empty(bounds[-1], _U)
    rows = np.repeat(np.arange(len(count)), each)
    full[count[rows] >= n] = out
    for d in short:
        k = np.arange(count[d])
        full[bounds[d]] = mix(np.sum(h[w.first[d] : w.first[d + 1]] * np.array([pow(_STEP, int(i), 1 << 64) for i in k], _U)) + np.array(count[d], _U) * _U(0x2545F4914F6CDD1D))
    if value is None:
        return full, bounds
    full_sums = np.zeros(bounds[-1], value.dtype)  # 0 for whole short sequences
    full_sums[count[rows] >= n] = sums
    return full, bounds, full_sums


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of a text table that go to a Python worker at a time.
ROWS_A_BATCH = 1000


def lean(spark: SparkSession) -> None:
    """Lets whole texts go to Python workers in batches of at most ``ROWS_A_BATCH`` rows: both sides hold a batch of them.

    This sets the session's ``spark.sql.execution.arrow.maxRecordsPerBatch``, unless it is smaller already.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_A_BATCH:
        spark.conf.set(name, str(ROWS_A_BATCH))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
