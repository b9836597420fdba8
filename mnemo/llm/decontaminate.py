"""Benchmark decontamination: SimHash of item-sized windows, a multi-index for all fingerprints within a radius,
exact weighted-shingle similarity.

A document's words are read in windows as long as each benchmark item. Windows that share no five-word
shingle with any item have similarity 0 with all and are not fingerprinted (this loses nothing). The
others get a 64-bit SimHash of their weighted shingles, from one running sum of the 64 bits' votes per
stretch of text. Four blocks of 16 bits index the items' fingerprints: two fingerprints within ``RADIUS``
differ by at most a quarter of it in some block, and each block's table lists the items within that many
bits of every value, so no fingerprint within the radius is missed. Candidates of the window's own
length are then verified exactly: weights of shared shingles over weights of all, at least ``SIMILARITY``.

A shingle's weight is 1 + log(items / items that hold it), so stock phrases of the benchmark count less;
shingles in no item weigh as those in one. Items of fewer than five words are one shingle of all their
words. Words are ``[^\\x20\\x09-\\x0D]+`` in lower case (of all scripts).

The benchmark is the query set: items are taken in passes of ``ITEMS_A_PASS`` against all documents. Items
per shingle are counted once over the whole benchmark, so weights don't depend on passes: a window may hold
shingles of any item, so every pass gets those that several items hold (16 bytes each; all others weigh as
one in one item). Beside these, what a task holds is bounded. Null and empty texts, and items without words, match nothing. A text shorter
than an item is one window. Equal items are reported each. Documents with null ids are matched too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .textops import _U, Words, blocks, lean, mix, shingles, words

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 4
ITEMS_A_PASS = 1000
_BITS = 16


def _votes(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One row of 64 votes a shingle: plus or minus its weight."""
    bits = np.unpackbits(mix(h ^ _U(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1)
    return np.where(bits, 1.0, -1.0) * weight[:, None]


def _packed(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 1e-9, axis=1).view(np.uint64).ravel()


@dataclass
class Index:
    """Items ready for lookup; built in each worker from the texts of one pass."""

    ids: list
    length: np.ndarray
    sets: list[np.ndarray]
    hashes: np.ndarray  # all shingles of the items of five words or more, ascending
    common: np.ndarray  # shingles that several items of the whole benchmark hold, ascending
    weights: np.ndarray  # of these
    other: float
    held_by: list[list[int]]  # lengths of the items that hold each shingle
    near: list[tuple[np.ndarray, np.ndarray]]  # by block: bounds by value, items
    prints: np.ndarray
    short: dict[int, dict[int, list[int]]]  # length -> shingle -> items

    def weigh(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.common, h), max(len(self.common) - 1, 0))
        return np.where(self.common[at] == h, self.weights[at], self.other) if len(self.common) else np.full(len(h), self.other)


def _masks(bits: int, most: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.int64)


Counts = tuple[int, np.ndarray, np.ndarray]  # items, shingles that several of them hold, how many do


def index(ids: list, texts: list[str], counts: Counts, radius: int = RADIUS) -> Index:
    """``counts`` are those of the whole benchmark."""
    texts = pc.utf8_lower(pa.array(texts, pa.string())).to_pylist()
    w = words(pa.array(texts, pa.string()))
    h, bounds = shingles(w, SHINGLE)
    count = w.per_row
    long = np.flatnonzero(count >= SHINGLE)
    sets = [np.unique(h[bounds[k] : bounds[k + 1]]) for k in range(len(ids))]
    hashes = np.unique(np.concatenate([sets[k] for k in long])) if len(long) else np.zeros(0, np.uint64)
    total, common, held = counts
    ix = Index(ids, count, sets, hashes, common, 1 + np.log(total / held), 1 + float(np.log(max(total, 1))), [], [], np.zeros(len(ids), np.uint64), {})
    held_by: list[set[int]] = [set() for _ in hashes]
    for k in long:
        for at in np.searchsorted(hashes, sets[k]):
            held_by[at].add(int(count[k]))
    prints = ix.prints
    for k in long:
        # The item's fingerprint is that of its own words in order, as a window's is.
        own = h[bounds[k] : bounds[k + 1]]
        prints[k] = _packed(_votes(own, ix.weigh(own)).sum(axis=0)[None])[0]
    masks = _masks(_BITS, radius // BLOCKS)
    for b in range(BLOCKS):
        value = ((prints[long] >> _U(_BITS * b)) & _U((1 << _BITS) - 1)).astype(np.int64)
        at, who = (value[:, None] ^ masks[None]).ravel(), np.repeat(long, len(masks))
        order = np.argsort(at, kind="stable")
        ix.near.append((np.searchsorted(at[order], np.arange((1 << _BITS) + 1)), who[order].astype(np.int32)))
    for k in np.flatnonzero((count > 0) & (count < SHINGLE)):
        n = int(count[k])
        one, _ = shingles(words(pa.array([texts[k]], pa.string())), n)
        ix.short.setdefault(n, {}).setdefault(int(one[0]), []).append(int(k))
    ix.held_by.extend(sorted(s) for s in held_by)
    return ix


Match = tuple[int, int, int, int, float, int]  # row, item, first word, words, similarity, distance


def _in_text(row: int, h: np.ndarray, n_words: int, hits: np.ndarray, found: np.ndarray, ix: Index, radius: int, least: float) -> Iterator[Match]:
    """Matches of one text. ``hits``: positions of shingles that some item holds; ``found``: their numbers in the index."""
    lengths: dict[int, list[int]] = {}
    for p, k in zip(hits.tolist(), found.tolist(), strict=True):
        for size in ix.held_by[k]:
            lengths.setdefault(size, []).append(p)
    best: dict[int, Match] = {}
    for size, at in lengths.items():
        size_here = min(size, n_words)
        span = size_here - SHINGLE + 1  # shingles in a window
        starts = np.unique(np.clip(np.concatenate([np.arange(p - span + 1, p + 1) for p in at]), 0, n_words - size_here))
        lo, hi = int(starts[0]), int(starts[-1]) + span
        part = h[lo:hi]
        weight = ix.weigh(part)
        total = np.zeros((len(part) + 1, 64))
        np.cumsum(_votes(part, weight), axis=0, out=total[1:])
        prints = _packed(total[starts - lo + span] - total[starts - lo])
        pairs = []
        for b, (bounds, who) in enumerate(ix.near):
            value = ((prints >> _U(_BITS * b)) & _U((1 << _BITS) - 1)).astype(np.int64)
            a, z = bounds[value], bounds[value + 1]
            each = z - a
            window = np.repeat(np.arange(len(prints)), each)
            item = who[np.arange(int(each.sum())) + np.repeat(a - (np.cumsum(each) - each), each)]
            pairs.append(window * len(ix.ids) + item)
        key = np.unique(np.concatenate(pairs))
        window, item = key // len(ix.ids), key % len(ix.ids)
        far = np.bitwise_count(prints[window] ^ ix.prints[item])
        ok = (far <= radius) & (ix.length[item] == size)
        for wi, k, d in zip(window[ok].tolist(), item[ok].tolist(), far[ok].tolist(), strict=True):
            own = np.unique(part[starts[wi] - lo : starts[wi] - lo + span])
            both = np.isin(own, ix.sets[k], assume_unique=True)
            shared = float(ix.weigh(own[both]).sum())
            whole = float(ix.weigh(own).sum() + ix.weigh(ix.sets[k]).sum()) - shared
            similar = shared / whole
            if similar >= least - 1e-12 and (k not in best or similar > best[k][4]):
                best[k] = (row, k, int(starts[wi]), size_here, similar, int(d))
    yield from best.values()


def matches(texts: pa.Array, ix: Index, radius: int = RADIUS, least: float = SIMILARITY) -> list[Match]:
    """The best window of every text for every item that it holds."""
    w: Words = words(pc.utf8_lower(texts))
    out: list[Match] = []
    if len(ix.hashes):
        h, bounds = shingles(w, SHINGLE)
        count = w.per_row
        at = np.minimum(np.searchsorted(ix.hashes, h), len(ix.hashes) - 1)
        hit = np.flatnonzero(ix.hashes[at] == h)
        row = np.searchsorted(bounds, hit, "right") - 1
        for r in np.unique(row[count[row] >= SHINGLE]).tolist():
            mine = hit[row == r]
            out += _in_text(r, h[bounds[r] : bounds[r + 1]], int(count[r]), mine - bounds[r], at[mine], ix, radius, least)
    for n, table in ix.short.items():
        h, bounds = shingles(w, n)
        known = np.array(list(table), np.uint64)
        hit = np.flatnonzero(np.isin(h, known))
        row = np.searchsorted(bounds, hit, "right") - 1
        met = set()
        for p, r in zip(hit.tolist(), row.tolist(), strict=True):
            for k in table[int(h[p])] if w.per_row[r] >= n else ():
                if (r, k) not in met:
                    met.add((r, k))
                    out.append((r, k, int(p - bounds[r]), n, 1.0, 0))
    return out


def _counts(items: DataFrame, text: str) -> Counts:
    """How many items there are, and hold each shingle, over the whole benchmark; rows that repeat an item count each."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            w = words(pc.utf8_lower(b.column("text")))
            h, bounds = shingles(w, SHINGLE)
            sets = [np.unique(h[bounds[k] : bounds[k + 1]]) for k in np.flatnonzero(w.per_row >= SHINGLE)]
            if sets:
                yield pa.record_batch({"shingle": np.concatenate(sets).view(np.int64)})

    texts = items.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    several = texts.mapInArrow(distinct, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 1").toArrow()
    shingle, held = several["shingle"].to_numpy().view(np.uint64), several["held"].to_numpy()
    order = np.argsort(shingle)
    return texts.count(), shingle[order], held[order]


def _passes(items: DataFrame, key: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """The items with words, ``ITEMS_A_PASS`` at a time."""
    clean = items.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")).orderBy("id", "text")
    ids: list = []
    texts: list[str] = []
    for r in clean.toLocalIterator():
        ids.append(r.id)
        texts.append(r.text)
        if len(ids) == ITEMS_A_PASS:
            yield ids, texts
            ids, texts = [], []
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
          radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """(key, item, first word, words, similarity, distance) of every document and item that it holds."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item_key}` {items.schema[item_key].dataType.simpleString()}, first_word int, n_words int, similarity double, distance int"
    lean(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    item_type = to_arrow_type(items.schema[item_key].dataType)
    out = None
    counts = docs.sparkSession.sparkContext.broadcast(_counts(items, item_text))
    for ids, texts in _passes(items, item_key, item_text):
        sent = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ix = None
            for b in blocks(batches, "text"):
                ix = ix or index(*sent.value, counts.value, radius)
                found = matches(b.column("text"), ix, radius, least)
                if found:
                    row, item, first, size, similar, far = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("key").take(pa.array(row)), pa.array([ix.ids[k] for k in item], item_type), pa.array(first, pa.int32()), pa.array(size, pa.int32()),
                         pa.array(similar, pa.float64()), pa.array(far, pa.int32())], names=[key, item_key, "first_word", "n_words", "similarity", "distance"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """The rows whose text holds no item, with their columns, in one pass over the texts for each pass of items."""
    lean(docs.sparkSession)
    counts = docs.sparkSession.sparkContext.broadcast(_counts(items, item_text))
    for ids, texts in _passes(items, item_key, item_text):
        sent = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ix = None
            for b in blocks(batches, text):
                ix = ix or index(*sent.value, counts.value, radius)
                stay = np.ones(b.num_rows, bool)
                stay[[m[0] for m in matches(b.column(text), ix, radius, least)]] = False
                yield b.filter(pa.array(stay))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
