"""N-gram Jaccard join: a prefix-tree join over globally ordered sets of word shingles.

The result is one row a document with its set's size and the component it belongs to, where two documents
are linked when the Jaccard similarity of their sets reaches the threshold exactly.

1. Every text becomes its set of n-word shingles (64-bit hashes). Equal sets are one class, known by
   128 bits of its set; only one text of each class goes on.
2. Shingles are ordered globally, rare ones first: by an estimate of how often they occur in the corpus,
   then by hash. The estimate is the larger of two, both from tables of ``SLOTS`` hashed counts over
   all classes: what the frequencies of its words make one expect, and how far the count of the
   shingle's own slot stands out. The order only decides how much work there is, never the result.
3. Sets as similar as asked share a shingle among the first ``size - ceil(t * size) + 1`` of both
   (prefix filter), and from that shingle's place on enough must be left in both. The smaller set is
   entered under the shingle and the band of its size, the larger under the bands it can reach. The
   least class of each shingle and band leads its group; a class is in the cluster of every leader it
   got this way, so any two linked classes meet in a cluster.
4. Most clusters hold sets that met by chance. Before any set is sent, each class has a sketch: how many of its
   shingles fall in each of a few hash buckets (a byte each, two to four shingles a bucket). The sum of
   the lesser counts bounds the overlap of two sets from above, so pairs that sketches rule out are not linked. Members
   without a partner left go, and a cluster falls into the parts that its remaining pairs connect.
5. In what is left the ordered sets are stored in a trie, commonest shingles first, so near copies
   share long paths. Each set walks the trie; partial overlaps are carried down and so shared, and a
   subtree is pruned when even all that remains of the shortest and the longest set below could
   not reach the threshold, or when all of it is already in the walker's component: more links there
   can't change the result.
6. Clusters of more than ``PART`` members are cut in parts. Each part is joined with itself beside
   the leader's set. Then members whose distance to the leader leaves a link between parts possible
   (Jaccard distance obeys the triangle inequality; two members linked to the leader need no
   look at each other) are joined part by part.
7. Links join classes to components, named by their least id.

With ``links`` every linked pair is found, not only as many as the components need: a trie is walked by all
sets at once (one look at each node, with the overlaps of the walkers still in reach), nothing is left out for
being in one component, and all pairs of parts of a cut cluster are joined. Two classes that meet in several
clusters are counted in that of the least leader they share: each member carries its lesser leaders. (Sketches rule
a pair out in all its clusters or in none.) Pairs are counted by class, weighted by how many documents each class has, and never written.

Limits: one document's set must fit in a task. The number of pairs of parts in steps 4 and 6 grows with the square
of the members of one cluster; in step 6 only those count that are near the leader without being linked to it, with ``links`` all.

Ids keep their type; ids of other types than whole numbers are compared as text. Nulls, empty texts and texts without words have an empty set, size 0, and are linked with nothing (their
own component, of their own id). Fewer words than n: the whole sequence is the one shingle. Repeated rows
each get a row. Null ids are least in no component of several documents with ids.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .textops import _U, blocks, lean, mix, runs, shingles, words, written

SLOTS = 1 << 20
_CHUNK = 1 << 14
PART = 2000
#: Width of a band of set sizes, as a logarithm.
BAND = 0.03
PART_TOKENS = 1 << 21
#: Shingles of slots that stand out by more occurrences than this are hot: aggregated before they are shuffled and joined back.
HOT = 1 << 12
#: Tables are sent to every task only up to this many bytes, counted first; beyond, they are joined by a shuffle.
SEND_BYTES = 16 << 20
#: Classes of more than one in so many documents are sent to every task: at most this many rows.
MOST_HOT = 1000
WHOLE = ("tinyint", "smallint", "int", "bigint")


def sets(texts: pa.Array, n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    h, bounds = shingles(words(texts, lower), n)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.unique(h[a:b])


def signature(s: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order."""
    return np.array([mix(s).sum(dtype=_U), mix(s ^ _U(0xA0761D6478BD642F)).sum(dtype=_U)], ">u8").tobytes()


def sketch(s: np.ndarray) -> np.ndarray:
    """How many of a set's shingles fall in each bucket of their first bits, a byte each (255: that many or more)."""
    bits = max(4, (len(s) - 1).bit_length() - 2)
    return np.minimum(np.bincount((s >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def folded(counts: np.ndarray, width: int) -> np.ndarray:
    """The sketch with fewer, wider buckets."""
    while len(counts) > width:
        counts = np.minimum(counts.reshape(-1, 2).sum(axis=1, dtype=np.int64), 255).astype(np.uint8)
    return counts


def may_link(size: np.ndarray, sketches: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> np.ndarray:
    """Labels of sets that a chain of possible links connects, as far as sketches tell; with ``side`` only links between different sides."""
    label, width = np.arange(len(size)), np.array([len(x) for x in sketches])
    order = np.argsort(size, kind="stable")
    reach = 1 << math.ceil(math.log2(den / num)) if num < den else 1
    for w in np.unique(width):
        at = order[(width[order] >= w) & (width[order] <= w * reach)]
        if len(at) < 2:
            continue
        counts, s = np.stack([folded(sketches[k], w) for k in at]), size[at]
        last = np.searchsorted(s, s * den // num, "right")  # larger partners are at most this long
        for i in np.flatnonzero((width[at] == w) & (last - np.arange(len(at)) > 1)):
            less = np.minimum(counts[i], counts[i + 1 : last[i]])
            most = np.where((less == 255).any(axis=1), s[i], np.minimum(less.sum(axis=1, dtype=np.int64), s[i]))
            hit = at[i + 1 : last[i]][den * most >= num * (s[i] + s[i + 1 : last[i]] - most)]
            if side is not None:
                hit = hit[side[hit] != side[at[i]]]
            if (label[hit] != label[at[i]]).any():
                label[np.isin(label, label[hit])] = label[at[i]]
    return label


def prefix_size(size: int, num: int, den: int) -> int:
    return size - -(-size * num // den) + 1


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> _U(44)).astype(np.int64)


_MADE = ["key", "size", "sig", "sketch", "chunk", "counts"]


def classes(docs: DataFrame, n: int) -> DataFrame:
    """Written rows of two kinds: (key, size, sig, sketch) of every document, and chunks of each task's counts (words, then shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, met, key_type = np.zeros(2 * SLOTS, np.int64), set(), None
        for b in blocks(batches, "text"):
            w = words(b.column("text"), True)
            h, bounds = shingles(w, n)
            size, sig, sketches = [], [], []
            for d, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                s = np.unique(h[lo:hi])
                size.append(len(s))
                sig.append(signature(s) if len(s) else None)
                sketches.append(sketch(s).tobytes() if len(s) else None)
                if len(s) and sig[-1] not in met:
                    met.add(sig[-1])
                    np.add.at(count, _slots(w.hash[w.first[d] : w.first[d + 1]]), 1)
                    np.add.at(count, SLOTS + _slots(s), 1)
            k, key_type = b.num_rows, b.schema.field("key").type
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(sketches, pa.binary()),
                                               pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=_MADE)
        if met:
            parts = [zlib.compress(count[i : i + _CHUNK].astype("<i8").tobytes(), 1) for i in range(0, 2 * SLOTS, _CHUNK)]
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, key_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names=_MADE)

    return written(docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, size long, sig binary, sketch binary, chunk int, counts binary"), "shingle-classes")


def rarity(made: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By slot: a word's part of the logarithm of its shingles' expected count, and a level for shingles that stand out.

    Twice the binary logarithm throughout. 5 bytes a slot, whatever the corpus.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_CHUNK, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(c), "<i8")
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "counts": [total.astype("<f4").tobytes()]})

    rows = made.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect()
    count = np.zeros(2 * SLOTS)
    for r in rows:
        count[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(r.counts, "<f4")
    of_words, of_shingles = count[:SLOTS], count[SLOTS:]
    total = max(of_words.sum(), 1.0)
    by_word = 2 * (np.log2(np.maximum(of_words, 1)) - np.log2(total) * (1 - 1 / n))
    usual = of_shingles.mean()
    above = of_shingles - usual - 4 * np.sqrt(usual)
    return by_word.astype(np.float32), np.where(above > 1, 128 + np.floor(2 * np.log2(np.maximum(above, 1))), 0).astype(np.uint8)


def ordered_sets(texts: pa.Array, n: int, by_word: np.ndarray, by_shingle: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's set (ascending) and the same in the global order."""
    w = words(texts, True)
    h, bounds, expected = shingles(w, n, by_word[_slots(w.hash)])
    level = np.maximum(np.clip(expected + 128, 0, 255).astype(np.uint8), by_shingle[_slots(h)])  # 128: expected once
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        s, at = np.unique(h[a:b], return_index=True)
        yield s, s[np.argsort(level[a:b][at], kind="stable")]


class Trie:
    """Sets as paths of a radix tree over a common order; leaves below a node are consecutive rows."""

    def __init__(self, rows: list[np.ndarray]):
        """``rows``: ascending ranks in the common order."""
        self.order = sorted(range(len(rows)), key=lambda k: rows[k].astype(">u4").tobytes())
        self.rows = [rows[k] for k in self.order]
        self.size = np.fromiter(map(len, self.rows), np.int64, len(rows))
        shared = [0] * len(rows)
        for k in range(1, len(rows)):
            a, b = self.rows[k - 1], self.rows[k]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[k] = int(differ[0]) if len(differ) else m
        self.shared = shared
        self.root = self._node(0, len(rows), 0) if rows else None

    def _node(self, lo: int, hi: int, start: int) -> dict:
        """Iterative, for paths may be deep: each node has its own stretch of path and its children."""
        root: dict = {}
        todo = [(root, lo, hi, start)]
        while todo:
            node, lo, hi, start = todo.pop()
            depth = min([len(self.rows[lo]), *self.shared[lo + 1 : hi]])
            size = self.size[lo:hi]
            node |= {"lo": lo, "hi": hi, "depth": depth, "path": self.rows[lo][start:depth], "least": int(size.min()), "most": int(size.max()), "under": []}
            cuts = [lo, *[k for k in range(lo + 1, hi) if self.shared[k] == depth], hi]
            ends = lo
            while ends < hi and self.size[ends] == depth:
                ends += 1  # sets that end here sort first
            node["ends"] = ends
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a >= ends:
                    child: dict = {}
                    node["under"].append(child)
                    todo.append((child, a, b, depth))
        return root


def link(members: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None, label: np.ndarray | None = None) -> np.ndarray:
    """Component labels of sets linked by 100 * similarity >= threshold, by trie.

    With ``side`` (0/1) only pairs of different sides are looked at. ``label`` holds components known before.
    """
    n = len(members)
    label = np.arange(n) if label is None else label.copy()
    if n < 2:
        return label
    flat = np.concatenate(members)
    values, ranks, count = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.empty(len(values), np.int64)
    place[np.lexsort((values, -count))] = np.arange(len(values))  # commonest first
    ranks = place[ranks]
    ends = np.cumsum([len(m) for m in members])
    trie = Trie([np.sort(r) for r in np.split(ranks, ends[:-1])])
    label = label[trie.order]
    side = None if side is None else side[trie.order]
    mask = np.zeros(len(values), bool)
    for q in range(n):
        need = label != label[q]
        need[: q + 1] = False
        if side is not None:
            need &= side != side[q]
        if not need.any():
            continue
        row, size = trie.rows[q], len(trie.rows[q])
        mask[row] = True
        todo = [(trie.root, 0)]
        while todo:
            node, overlap = todo.pop()
            lo, hi = node["lo"], node["hi"]
            if hi <= q or not need[lo:hi].any():
                continue
            path = node["path"]
            overlap += int(mask[path].sum())
            depth = node["depth"]
            passed = int(np.searchsorted(row, path[-1], "right")) if len(path) else None
            left = min(node["most"] - depth, size - (overlap if passed is None else max(passed, overlap)))
            best = overlap + left
            # The shortest set below has the smallest union.
            if den * best < num * (size + max(node["least"], best) - best):
                continue
            for k in range(lo, node["ends"]):
                if need[k] and den * overlap >= num * (size + depth - overlap):
                    label[label == label[k]] = label[q]
                    need = (label != label[q]) & (np.arange(n) > q)
                    if side is not None:
                        need &= side != side[q]
            todo += [(child, overlap) for child in node["under"]]
        mask[row] = False
    back = np.empty(n, np.int64)
    back[trie.order] = label
    return back


def links_of(members: list[np.ndarray], num: int, den: int, weight: np.ndarray, earlier: list, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Component labels, and for each set the weight of all sets linked to it, by one walk of a trie with all sets.

    Pairs with a common entry in ``earlier`` are left to another cluster. With ``side`` (0/1) only pairs of different sides are looked at.
    """
    n = len(members)
    label, found = np.arange(n), np.zeros(n, np.int64)
    under = np.arange(n) if side is None else np.flatnonzero(side)
    if n < 2 or not 0 < len(under) < n + (side is None):
        return label, found
    values, ranks, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    place = np.empty(len(values), np.int64)
    place[np.lexsort((values, -count))] = np.arange(len(values))  # commonest first
    rows = [np.sort(r) for r in np.split(place[ranks], np.cumsum([len(m) for m in members])[:-1])]
    trie = Trie([rows[k] for k in under])
    leaf = under[trie.order]
    walker = leaf if side is None else np.flatnonzero(side == 0)
    size = np.array([len(rows[k]) for k in walker])
    first = np.cumsum(size) - size
    flat = np.concatenate([rows[k] for k in walker])
    owner = np.repeat(np.arange(len(walker)), size)
    keys = owner * len(values) + flat
    order = np.argsort(flat, kind="stable")
    holds, start = owner[order], np.searchsorted(flat[order], np.arange(len(values) + 1))  # walkers that hold each value
    met: dict[int, list[int]] = {}
    for i, k in enumerate(walker.tolist()):
        for e in earlier[k]:
            met.setdefault(int(e), []).append(i)
    todo = [(trie.root, np.arange(len(walker)), np.zeros(len(walker), np.int64))]
    while todo:
        node, alive, overlap = todo.pop()
        lo, hi, path, depth = node["lo"], node["hi"], node["path"], node["depth"]
        if side is None:
            on = alive < hi - 1  # a pair is found by the first of both
            alive, overlap = alive[on], overlap[on]
        if not len(alive):
            continue
        passed = overlap
        if len(path):
            a, each = start[path], start[path + 1] - start[path]
            ends = np.cumsum(each)
            total, at = np.zeros(len(walker), np.int64), 0
            while at < len(path):  # a bounded number of places at a time
                end = max(at + 1, int(np.searchsorted(ends, ends[at] - each[at] + (1 << 20), "right")))
                some = each[at:end]
                total += np.bincount(holds[np.arange(int(some.sum())) + np.repeat(a[at:end] - (np.cumsum(some) - some), some)], minlength=len(walker))
                at = end
            overlap = overlap + total[alive]
            passed = np.searchsorted(keys, alive * len(values) + path[-1], "right") - first[alive]
        left = np.minimum(node["most"] - depth, size[alive] - np.maximum(passed, overlap))
        best = overlap + left
        on = den * best >= num * (size[alive] + np.maximum(node["least"], best) - best)
        alive, overlap = alive[on], overlap[on]
        for k in range(lo, node["ends"]):
            hit = alive[(den * overlap >= num * (size[alive] + depth - overlap)) & ((alive < k) | (side is not None))]
            own = int(leaf[k])
            if len(hit) and len(earlier[own]):
                elsewhere = np.zeros(len(walker), bool)
                for e in earlier[own]:
                    elsewhere[met.get(int(e), [])] = True
                hit = hit[~elsewhere[hit]]
            if len(hit):
                who = walker[hit]
                found[who] += weight[own]
                found[own] += weight[who].sum()
                if (label[who] != label[own]).any():
                    label[np.isin(label, label[who])] = label[own]
        if len(alive):
            todo += [(child, alive, overlap) for child in node["under"]]
    return label, found


def node_of(key: str, kind: str) -> Column:
    """A class's name in the graph: its least id in bytes that sort like ids; classes without any id come last."""
    if kind in WHOLE:
        flipped = F.col(key).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
        named = F.unhex(F.lpad(F.hex(flipped), 16, "0"))
    else:
        named = F.col(key).cast("string").cast("binary")
    return F.when(F.col(key).isNull(), F.concat(F.unhex(F.lit("01")), F.col("sig"))).otherwise(F.concat(F.unhex(F.lit("00")), named))


def id_of(node: Column, kind: str) -> Column:
    rest = F.substring(node, 2, 1 << 30)
    if kind in WHOLE:
        found = F.conv(F.hex(rest), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    else:
        found = rest.cast("string")
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", found.cast(kind))


def sendable(df: DataFrame, bytes_a_row: Column) -> DataFrame:
    """With a hint to send it to every task, if it holds at most ``SEND_BYTES``."""
    total = df.agg(F.sum(bytes_a_row)).first()[0] or 0
    return F.broadcast(df) if total <= SEND_BYTES else df


def key_bytes(name: str) -> Column:
    return F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + 16


def in_parts(rows: DataFrame, sizes: DataFrame, part: int) -> DataFrame:
    """(leader, parts) of clusters (leader, head): as many parts as members and the sizes of their sets ask for."""
    per = rows.join(sizes, "head").groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("tokens"))
    return per.select("leader", F.greatest(F.ceil(F.col("members") / part), F.ceil(F.col("tokens") / PART_TOKENS)).cast("int").alias("parts"))


def survivors(member: DataFrame, of_class: DataFrame, num: int, den: int, part: int) -> DataFrame:
    """(leader, sub, head, parts) of the members whose sketches leave a link to another member possible.

    ``sub`` tells apart the pieces of a cluster that no possible link connects; clusters of several parts stay whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for group in runs(batches, ["leader", "a", "b"]):
            if group.num_rows < 2:
                continue
            head, size, side = (group.column(c).to_numpy() for c in ("head", "size", "part"))
            sketches = [np.frombuffer(x, np.uint8) for x in group.column("sketch").to_pylist()]
            a, b, parts = (int(group.column(c)[0].as_py()) for c in ("a", "b", "parts"))
            label = may_link(size, sketches, num, den, (side == b).astype(int) if a < b else None)
            stay = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
            if len(stay):
                k = len(stay)
                out.append((np.full(k, group.column("leader")[0].as_py()), label[stay] if parts == 1 else np.zeros(k, np.int64), head[stay], np.full(k, parts)))
                n += k
            if n > 50_000:
                yield table_of(out)
                out, n = [], 0
        if out:
            yield table_of(out)

    def table_of(out):
        leader, sub, head, parts = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.record_batch({"leader": leader, "sub": pa.array(sub, pa.int32()), "head": head, "parts": pa.array(parts, pa.int32())})

    parts = in_parts(member, of_class.select("head", "size"), part)
    dealt = member.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("head"), F.col("parts")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("leader", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "parts", "head")
    rows = dealt.join(of_class.select("head", "size", "sketch"), "head").repartition("leader", "a", "b").sortWithinPartitions("leader", "a", "b", "head")
    return written(rows.mapInArrow(run, "leader long, sub int, head long, parts int").distinct(), "candidates")


def joined(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", part: int = PART, links: bool = True) -> DataFrame:
    """(key, n_shingles, component, n_links) of every row: documents linked at Jaccard >= num / den over n-word shingles.

    ``n_links`` is how many other rows the row is linked to; without ``links`` it is left out, and only the links that components need are looked for.
    """
    spark = docs.sparkSession
    lean(spark)
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    made = classes(docs, n)
    made_level = rarity(made, n)
    level = spark.sparkContext.broadcast(made_level)  # 5 * SLOTS bytes
    hot_level = 128 + int(2 * math.log2(HOT))
    rows = made.where("chunk is null").select("key", "size", "sig", "sketch")

    def prefixes(batches: Iterator[pa.RecordBatch], hot: bool) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for b in blocks(batches, "text"):
            tokens, owners, sizes, places = [], [], [], []
            for s, in_order in ordered_sets(b.column("text"), n, *level.value):
                if len(s):
                    sig = signature(s)
                    if sig not in met:
                        met.add(sig)
                        first = in_order[: prefix_size(len(s), num, den)]
                        place = np.flatnonzero((level.value[1][_slots(first)] >= hot_level) == hot)
                        tokens.append(first[place])
                        owners.append(np.full(len(place), np.frombuffer(sig, ">i8")[0], np.int64))
                        sizes.append(np.full(len(place), len(s), np.int32))
                        places.append(place.astype(np.int32))
            if tokens:
                yield pa.record_batch({"token": np.concatenate(tokens).view(np.int64), "head": np.concatenate(owners), "size": np.concatenate(sizes), "place": np.concatenate(places)})

    def spread(hot: bool) -> DataFrame:
        """Rows of the prefixes' shingles; equal sets met by several tasks give equal rows, which changes nothing below."""
        return docs.select("text").mapInArrow(lambda batches: prefixes(batches, hot), "token long, head long, size int, place int")

    # With the shared shingle at a place, a set can still reach partners of up to ``most`` shingles. In a linked pair the smaller
    # set reaches its own size (it is found in its own band), the larger looks in the bands from num / den of its size on.
    size, t = F.col("size").cast("double"), num / den
    most = (size - F.col("place")) * ((1 + t) / t) - size + 1e-6

    def band(x):
        return F.floor(F.log(F.greatest(x, F.lit(1.0))) / BAND).cast("int")

    low, high = band(size * t * (1 - 1e-9)), band(F.least(size, most))
    role = F.concat(F.when(most >= size, F.array(F.struct(band(size).alias("band"), F.lit(True).alias("found")))).otherwise(F.array().cast("array<struct<band:int,found:boolean>>")),
                    F.when(most >= size * t * (1 - 1e-9), F.transform(F.sequence(low, F.greatest(low, high)), lambda b: F.struct(b.alias("band"), F.lit(False).alias("found")))).otherwise(
                        F.array().cast("array<struct<band:int,found:boolean>>")))
    def by_band(rows: DataFrame) -> DataFrame:
        return rows.select("token", "head", F.explode(role).alias("role")).select("token", "head", "role.band", "role.found")

    last = {"leader": F.min("head"), "_last": F.max("head"), "_found": F.max("found")}
    # One shuffle by shingle serves both windows; a shingle that is not hot has a bounded number of rows.
    several = spread(False).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("_n > 1")
    member = by_band(several).withColumns({k: v.over(Window.partitionBy("token", "band")) for k, v in last.items()}).where(
        "leader < _last and _found").select("leader", "head")
    if (made_level[1] >= hot_level).any():
        banded = by_band(spread(True))
        groups = banded.groupBy("token", "band").agg(*[v.alias(k) for k, v in last.items()]).where("leader < _last and _found").select("token", "band", "leader")
        member = member.unionByName(banded.join(groups, ["token", "band"]).select("leader", "head"))
    member = written(member.distinct(), "clusters")

    # One row a class; a text that very many documents share is combined before the shuffle.
    heads = F.conv(F.hex(F.substring("sig", 1, 8)), 16, -10).cast("long")
    of_class = written(rows.where("size > 0").groupBy("sig").agg(
        F.min("key").alias("key"), F.max("size").alias("size"), F.max("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")).withColumns(
        {"head": heads, "node": node_of("key", kind)}), "class-rows")
    sizes = of_class.select("head", "size")
    kept = survivors(member, of_class, num, den, part)

    # Parts of what is left of clusters that were cut, from the sizes of its sets alone.
    some = kept.where("parts > 1").select("leader", "head")
    parts = written(in_parts(some, sizes, part), "parts")
    again = some.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("head"), F.col("parts")).cast("int"))
    # The leader is a member of its own cluster; of a cut cluster, of every part.
    also = parts.where("parts > 1").select(F.col("leader"), "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("head"))
    placed = again.select("leader", "parts", "part", "head").unionByName(also).distinct().withColumn("sub", F.lit(0)).unionByName(
        kept.where("parts = 1").select("leader", "parts", F.lit(0).alias("part"), "head", "sub"))
    placed = placed.join(of_class.select("head", "sig", "node", *(["copies"] if links else [])), "head")
    if links:
        led = kept.select("leader", "head").distinct().groupBy("head").agg(F.collect_list("leader").alias("leaders"))
        placed = placed.join(led, "head").withColumn("earlier", F.filter("leaders", lambda x: x < F.col("leader"))).drop("leaders")
    placed = written(placed, "places")

    # One text of every class in a cluster, as its set.
    needed = placed.select("head").distinct().join(of_class.select("head", "key"), "head").select(F.col("key").alias("wanted")).distinct()
    needed = sendable(written(needed, "class-texts"), key_bytes("wanted"))
    texts = docs.join(needed, F.col("key").eqNullSafe(F.col("wanted")), "left_semi")

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            got = [s for s in sets(b.column("text"), n) if len(s)]
            yield pa.record_batch({"sig": pa.array([signature(s) for s in got], pa.binary()), "tokens": pa.array([s.tobytes() for s in got], pa.binary())})

    held = texts.select("text").mapInArrow(as_sets, "sig binary, tokens binary")
    slim = F.octet_length("node") + (F.size("earlier") * 8 if links else F.lit(0)) + 64
    own = held.join(sendable(placed, slim), "sig")

    def unpack(pdf: pd.DataFrame) -> tuple[list[bytes], list[np.ndarray]]:
        seen = dict(zip(map(bytes, pdf["node"]), pdf["tokens"], strict=True))
        return list(seen), [np.frombuffer(t, _U) for t in seen.values()]

    def forest(nodes: list[bytes], label: np.ndarray, known: np.ndarray | None = None) -> list[tuple[bytes, bytes]]:
        """One edge from each set to the first of its component."""
        first: dict[int, int] = {}
        return [(nodes[k], nodes[first.setdefault(int(c), k)]) for k, c in enumerate(label) if first.setdefault(int(c), k) != k]

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        """A part beside its leader: links, and for a cut cluster how far each member is from the leader."""
        pdf = pdf.sort_values("node").drop_duplicates("node")
        nodes, members = unpack(pdf)
        # The leader first: its links settle most of a group of near copies. A cluster in one piece may have lost it; then the first leads.
        lead = int(pdf["leader"].iloc[0])
        at = int(np.argmax(pdf["head"].to_numpy() == lead))
        nodes[0], nodes[at], members[0], members[at] = nodes[at], nodes[0], members[at], members[0]
        common = np.array([len(np.intersect1d(members[0], m, assume_unique=True)) for m in members])
        size = np.array([len(m) for m in members])
        union = size + size[0] - common
        label = np.arange(len(nodes))
        label[den * common >= num * union] = 0
        label = link(members, num, den, label=label)
        edges = forest(nodes, label)
        cut = int(pdf["parts"].iloc[0]) > 1
        out = [(u, v, None, None, None) for u, v in edges]
        if cut:
            out += [(None, None, s, lead, float(1 - c / w)) for s, c, w in zip(nodes, common, union, strict=True)]
        u, v, node, by, far = zip(*out, strict=True) if out else ((),) * 5
        # Nullable integers: a float column would round the leader's 64 bits.
        return pd.DataFrame({"u": pd.Series(u, dtype=object), "v": pd.Series(v, dtype=object), "node": pd.Series(node, dtype=object),
                             "leader": pd.array(by, dtype="Int64"), "far": pd.Series(far, dtype=float)})

    if links:
        edges, counts = _all_links(own, num, den, forest)
    else:
        named = held.join(of_class.select("sig", "node"), "sig").select("node", "tokens")
        edges, counts = _of_components(own, named, parts, within, num, den, part, unpack, forest), None
    roots = components(edges)
    # Each class's root (itself without links) is named by the component's least id.
    known = of_class.select("sig", "node", "copies").join(roots, "node", "left")
    known = known.select("sig", "node", "copies", id_of(F.coalesce("root", "node"), kind).alias("component"))
    if links:
        # The other rows of its own class, and all rows of classes linked to it.
        known = known.join(counts, "node", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0))).drop("links")
    known = written(known.drop("node"), "class-components")
    # Documents take what is known of their class; the few classes that may each hold very many documents are sent to all tasks.
    linked = rows.where("size > 0").select("key", "size", "sig")
    total = known.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(known.where(F.col("copies") * MOST_HOT > total).drop("copies"))
    cold = known.where(F.col("copies") * MOST_HOT <= total).drop("copies")
    out = linked.join(hot, "sig").unionByName(linked.join(hot.select("sig"), "sig", "left_anti").join(cold, "sig"))
    alone = rows.where("size = 0").withColumn("component", F.col("key"))
    if links:
        alone = alone.withColumn("n_links", F.lit(0).cast("long"))
    more = ["n_links"] if links else []
    out = out.select("key", "size", "component", *more).unionByName(alone.select("key", "size", "component", *more))
    return out.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), "component", *more)


def _all_links(own: DataFrame, num: int, den: int, forest) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) that give the components of all links, and (node, links) of the classes with links to others."""

    def found(pdf: pd.DataFrame, side: bool) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        nodes, members = list(map(bytes, pdf["node"])), [np.frombuffer(t, _U) for t in pdf["tokens"]]
        label, links = links_of(members, num, den, pdf["copies"].to_numpy(), list(pdf["earlier"]), (pdf["part"] == pdf["b"]).to_numpy().astype(int) if side else None)
        out = [(u, v, None, None) for u, v in forest(nodes, label)] + [(None, None, nodes[k], int(links[k])) for k in np.flatnonzero(links)]
        u, v, node, n = zip(*out, strict=True) if out else ((),) * 4
        return pd.DataFrame({"u": pd.Series(u, dtype=object), "v": pd.Series(v, dtype=object), "node": pd.Series(node, dtype=object), "links": pd.array(n, dtype="Int64")})

    schema = "u binary, v binary, node binary, links long"
    every = own.groupBy("leader", "sub", "part").applyInPandas(lambda pdf: found(pdf, False), schema)
    # The leader has met all members, as it is in every part. Each other member goes to all pairs of parts with its own; a pair is one task.
    sent = own.where("parts > 1 and head != leader").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other != part").withColumns(
        {"a": F.least("part", "other"), "b": F.greatest("part", "other")})
    every = written(every.unionByName(sent.groupBy("leader", "a", "b").applyInPandas(lambda pdf: found(pdf, True), schema)), "links")
    return every.where("u is not null").select("u", "v"), every.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))


def _of_components(own: DataFrame, held: DataFrame, parts: DataFrame, within, num: int, den: int, part: int, unpack, forest) -> DataFrame:
    """As many links (u, v) as the components need. ``held``: (node, tokens) of every class in a cluster."""
    grouped = own.groupBy("leader", "sub", "part")
    first = written(grouped.applyInPandas(within, "u binary, v binary, node binary, leader long, far double"), "links")
    edges = first.where("u is not null").select("u", "v")
    cut = parts.where("parts > 1").select("leader")
    if cut.limit(1).count():
        edges = edges.unionByName(_between(first, held, num, den, part, unpack, forest))
    return edges


def _between(first: DataFrame, held: DataFrame, num: int, den: int, part: int, unpack, forest) -> DataFrame:
    """Links between parts of cut clusters.

    Two members linked to the leader are in one component already. A member at distance f > 1 - t can only
    link to members at distance f - (1 - t) or more, and of the linked ones only those are taken along.
    """
    near = 1 - num / den
    far = first.where("node is not null").select("leader", "node", "far").distinct()
    loose = far.where(F.col("far") > near)
    reach = loose.groupBy("leader").agg(F.min("far").alias("nearest"), F.count(F.lit(1)).alias("loose"))
    some = far.join(reach, "leader").where(F.col("far") >= F.col("nearest") - near - 1e-9)
    size = some.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    placed = some.join(size, "leader").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    # Each member goes to all pairs of parts with its own; a pair of parts is one task.
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "leader", "node", "far", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        far_of = dict(zip(map(bytes, pdf["node"]), pdf["far"], strict=True))
        part_of = dict(zip(map(bytes, pdf["node"]), pdf["part"], strict=True))
        nodes, members = unpack(pdf)
        label = np.arange(len(nodes))
        linked = np.array([far_of[s] <= near for s in nodes])
        label[linked] = len(nodes)
        label = np.where(linked, np.argmax(linked) if linked.any() else 0, label)
        one = int(pdf["a"].iloc[0]) == int(pdf["b"].iloc[0])
        side = None if one else np.array([int(part_of[s] == pdf["b"].iloc[0]) for s in nodes])
        label = link(members, num, den, side, label)
        return pd.DataFrame(forest(nodes, label), columns=["u", "v"])

    return written(sent.join(held, "node").groupBy("leader", "a", "b").applyInPandas(across, "u binary, v binary"), "links-between")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without near copies: of each component the row with the least id stays.

    Rows with empty sets, and rows with a null id, all stay; of rows that repeat an id at most one stays. Texts are not
    shuffled: the ids that go are sent to all tasks, as long as they hold at most ``SEND_BYTES``.
    """
    found = joined(docs, n, num, den, key, text, links=False)
    own = "_own"
    while own in docs.columns:
        own += "_"
    ids = found.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(own)).agg(
        F.max(F.col(key) == F.col("component")).alias("stays"), F.count(F.lit(1)).alias("n"))
    changed = written(ids.where("not stays or n > 1"), "ids-that-go")
    several = changed.where("stays").select(own)
    left = docs.join(sendable(changed.select(own), key_bytes(own)), F.col(key) == F.col(own), "left_anti")
    if not several.limit(1).count():
        return left
    return left.unionByName(docs.join(several, F.col(key) == F.col(own), "left_semi").dropDuplicates([key]))
