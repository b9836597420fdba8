"""Byte-level BPE encoding and decoding: speculate, verify, and merge exactly only where that fails.

For every new word of a block of texts, greedy longest match proposes tokens. A sequence of tokens
is what merging gives if and only if every adjacent pair is: merging the pair's bytes gives that very pair
back. So all adjacent pairs of all proposals are looked up at once in a sorted table of known
verdicts (numpy); pairs not met before are settled by merging their few bytes. Words with a failing
pair, and only these, are merged exactly: many short words side by side, one merge a round in each; long
ones by a heap, so a very long word costs n log n.

Words are kept per Python worker with their tokens, up to ``KEPT_WORDS`` (memory bound; the results
don't depend on it). The tokenizer file is read once per worker; its path is a parameter.

Null and empty texts have no tokens and decode to the empty text. The special token's string in a
text is that token, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textops import blocks, lean

#: Fixed values of byte-level BPE: the pattern that cuts words, and the printable stand-ins of bytes.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

KEPT_WORDS = 400_000
#: Words of more bytes are merged one by one, by a heap.
LONG_WORD = 64


def _byte_of_stand_in() -> dict[str, int]:
    rest = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = _byte_of_stand_in()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.id = {bytes(stand_in[c] for c in s): i for s, i in vocab.items() if s not in self.special}
        self.bytes = {i: b for b, i in self.id.items()} | {i: s.encode() for s, i in self.special.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.byte = np.array([self.id[bytes([b])] for b in range(256)], np.int64)
        keys = np.array([a << 16 | b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], order
        self.merge_made = np.array([m[1] for m in self.merge.values()], np.int64)
        self.cut = regex.compile(WORD)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pairs, self.verdicts = np.zeros(0, np.int64), np.zeros(0, bool)
        size = max(self.bytes) + 1
        self.raw = _Ragged([self.bytes.get(i, b"") for i in range(size)])
        self.decimal = _Ragged([b"%d," % i for i in range(size)])
        self._index_vocabulary()
        self.reset()

    def reset(self) -> None:
        self.code = {s: k for k, s in enumerate(self.special)}
        self.tokens = np.array(list(self.special.values()), np.int64)
        self.size = np.ones(len(self.special), np.int64)

    def _index_vocabulary(self) -> None:
        """Tokens by (length, hash), and the prefixes of tokens, for longest match at many places at once."""
        tokens = list(self.id)
        self.longest = max(map(len, tokens))
        self.by_length = {}
        for n in range(2, self.longest + 1):
            full = [t for t in tokens if len(t) == n]
            prefix = {t[:n] for t in tokens if len(t) > n}
            h = _hash_all(full, n)
            order = np.argsort(h)
            self.by_length[n] = h[order], np.array([self.id[t] for t in full], np.int64)[order], np.sort(_hash_all(list(prefix), n))

    def merged(self, word: bytes) -> list[int]:
        """Exact merging of one word: lowest rank first, leftmost among equals."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(k: int, a: int, b: int) -> None:
            if (a, b) in self.merge:
                rank, made = self.merge[a, b]
                heapq.heappush(heap, (rank, k, made, a, b))

        for k in range(n - 1):
            offer(k, ids[k], ids[k + 1])
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            right = after[k]
            if ids[k] != a or right < 0 or ids[right] != b:
                continue
            ids[k], ids[right], after[k] = new, -1, after[right]
            if after[k] >= 0:
                before[after[k]] = k
                offer(k, new, ids[after[k]])
            if before[k] >= 0:
                offer(before[k], ids[before[k]], new)
        return [i for i in ids if i >= 0]

    def merged_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words side by side, one merge a round in each: tokens and their number by word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        long = np.flatnonzero(size > LONG_WORD)
        if len(long):
            short = np.flatnonzero(size <= LONG_WORD)
            out: list = [None] * len(words)
            ids, n = self.merged_all([words[k] for k in short])
            for k, part in zip(short, np.split(ids, np.cumsum(n)[:-1]) if len(n) else [], strict=True):
                out[k] = part
            for k in long:
                out[k] = np.array(self.merged(words[k]), np.int64)
            return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        done_ids, done_owner = [], []
        none = len(self.merge_made)
        while len(ids):
            inner = owner[:-1] == owner[1:]
            keys = ids[:-1] << 16 | ids[1:]
            at = np.minimum(np.searchsorted(self.merge_keys, keys), none - 1)
            rank = np.full(len(ids), none, np.int64)
            rank[:-1] = np.where(inner & (self.merge_keys[at] == keys), self.merge_ranks[at], none)
            head = np.flatnonzero(np.concatenate([[True], ~inner]))
            best = np.minimum.reduceat(rank * len(ids) + np.arange(len(ids)), head)
            where, least = best % len(ids), best // len(ids)
            over = least == none
            each = np.diff(np.append(head, len(ids)))
            ended = np.repeat(over, each)
            done_ids.append(ids[ended])
            done_owner.append(owner[ended])
            where, least = where[~over], least[~over]
            ids = ids.copy()
            ids[where] = self.merge_made[least]
            keep = ~ended
            keep[where + 1] = False
            ids, owner = ids[keep], owner[keep]
        flat, owner = np.concatenate([*done_ids, ids]), np.concatenate([*done_owner, owner])
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(words))

    def proposed(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of many words (their bytes in a row): tokens and their number by word."""
        end = np.cumsum(size)
        n = len(raw)
        left = np.repeat(end, size) - np.arange(n)  # bytes to the word's end
        best, length = self.byte[raw], np.ones(n, np.int64)
        total, power = _prefix_hash(raw)
        at = np.arange(n)
        for k in range(2, self.longest + 1):
            at = at[left[at] >= k]
            if not len(at):
                break
            h = (total[at + k] - total[at]) * power[at]
            full, ids, prefix = self.by_length[k]
            if len(full):
                i = np.minimum(np.searchsorted(full, h), len(full) - 1)
                hit = full[i] == h
                best[at[hit]], length[at[hit]] = ids[i[hit]], k
            if not len(prefix):
                break
            i = np.minimum(np.searchsorted(prefix, h), len(prefix) - 1)
            at = at[prefix[i] == h]
        place, word = end - size, np.arange(len(size))
        places, words = [], []
        while len(place):
            places.append(place)
            words.append(word)
            place = place + length[place]
            more = place < end[word]
            place, word = place[more], word[more]
        where, word = np.concatenate(places), np.concatenate(words)
        order = np.argsort(where)
        return best[where[order]], np.bincount(word, minlength=len(size))

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """For every pair key (left * 65536 + right; a lone token as -1 - token): does merging give it back?"""
        distinct, where = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pairs, distinct), max(len(self.pairs) - 1, 0))
        fresh = distinct[self.pairs[at] != distinct] if len(self.pairs) else distinct
        if len(fresh):
            vocab = self.bytes
            ids, n = self.merged_all([vocab[k >> 16] + vocab[k & 0xFFFF] if k >= 0 else vocab[-1 - k] for k in fresh.tolist()])
            first = np.cumsum(n) - n
            last = ids[first + n - 1]
            found = np.where(fresh >= 0, (n == 2) & (ids[first] << 16 | last == fresh), (n == 1) & (-1 - last == fresh))
            keys_now = np.concatenate([self.pairs, fresh])
            order = np.argsort(keys_now)
            self.pairs, self.verdicts = keys_now[order], np.concatenate([self.verdicts, found])[order].astype(bool)
        return self.verdicts[np.searchsorted(self.pairs, distinct)][where]

    def learn(self, new: list[str]) -> None:
        """Adds the tokens of words not met before."""
        words = [w.encode("utf-8", "surrogatepass") for w in new]
        flat, size = self.proposed(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))
        end = np.cumsum(size)
        inner = np.ones(len(flat), bool)
        inner[end - 1] = False  # the last token of a word has no right neighbour
        left = np.flatnonzero(inner)
        word = np.repeat(np.arange(len(new)), size)
        lone = np.flatnonzero(size == 1)
        keys = np.concatenate([flat[left] << 16 | flat[left + 1], -1 - flat[end[lone] - 1]])
        fails = np.zeros(len(new), bool)
        fails[np.concatenate([word[left], lone])[~self.compatible(keys)]] = True
        again = np.flatnonzero(fails)
        right, size_right = self.merged_all([words[k] for k in again.tolist()])
        kept = ~fails
        code = len(self.size)
        order = [*np.flatnonzero(kept).tolist(), *again.tolist()]
        for w in order:
            self.code[new[w]] = code
            code += 1
        self.tokens = np.concatenate([self.tokens, flat[np.repeat(kept, size)], right])
        self.size = np.concatenate([self.size, size[kept], size_right])

    def pieces(self, text: str) -> list[str]:
        if self.cut_special is None or not any(s in text for s in self.special):
            return self.cut.findall(text)
        out: list[str] = []
        for part in self.cut_special.split(text):
            out += [part] if part in self.special else self.cut.findall(part)
        return out

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and their number by text."""
        if len(self.code) > KEPT_WORDS:
            self.reset()
        cut = [self.pieces(t) for t in texts]
        new = list(set().union(*cut) - self.code.keys()) if cut else []
        if new:
            self.learn(new)
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(cut)), np.int64, int(count.sum()))
        start = np.cumsum(self.size) - self.size
        size = self.size[codes]
        return self.tokens[_ranges(start[codes], size)], np.add.reduceat(np.append(size, 0), np.minimum(np.cumsum(count) - count, len(size))) * (count > 0)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of start[0] .. start[0] + size[0] - 1, then of the next, and so on."""
    shift = start - (np.cumsum(size) - size)
    return np.arange(int(size.sum())) + np.repeat(shift, size)


class _Ragged:
    """Byte strings in one array, to take many by number at once."""

    def __init__(self, items: list[bytes]):
        self.size = np.fromiter(map(len, items), np.int64, len(items))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(items), np.uint8)

    def take(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """Joined items of each row, where row k has count[k] of the ids."""
        size = self.size[ids]
        flat = self.flat[_ranges(self.start[ids], size)].tobytes()
        end = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))].tolist()
        return [flat[a:b] for a, b in zip(end[:-1], end[1:], strict=True)]


_STEP = 0x9E3779B97F4A7C15


def _prefix_hash(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(len(raw) + 1, _STEP, np.uint64)
    up[0] = 1
    down = np.full(len(raw) + 1, pow(_STEP, -1, 1 << 64), np.uint64)
    down[0] = 1
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * np.cumprod(up)[:-1], out=total[1:])
    return total, np.cumprod(down)


def _hash_all(items: list[bytes], n: int) -> np.ndarray:
    if not items:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b"".join(items), np.uint8).reshape(len(items), n).astype(np.uint64) + np.uint64(1)
    return (raw * np.array([pow(_STEP, k, 1 << 64) for k in range(n)], np.uint64)).sum(axis=1, dtype=np.uint64)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_TYPES = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_sha256": T.StringType(),
          "decoded": T.StringType(), "decoded_sha256": T.StringType()}


def encode(docs: DataFrame, path: str | None = None, text: str = "text", want: tuple[str, ...] = ("ids",)) -> DataFrame:
    """The rows with the columns of ``want`` after theirs (a column of that name is replaced): ``ids``,
    ``n_tokens``, ``decoded`` (the text that the ids give back), and SHA-256 digests of both."""
    lean(docs.sparkSession)
    path = path or default_path()
    kept = [f for f in docs.schema.fields if f.name not in want]
    schema = T.StructType([*kept, *[T.StructField(k, _TYPES[k]) for k in want]])
    text_too = text not in [f.name for f in kept]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec(path)

        def sha(items: list[bytes]) -> pa.Array:
            return pa.array([hashlib.sha256(b).hexdigest() for b in items], pa.string())

        for block in blocks(batches, text):
            ids, count = tok.block([t or "" for t in block.column(text).to_pylist()])
            made = {}
            if "ids" in want:
                made["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(ids, pa.int32()))
            if "n_tokens" in want:
                made["n_tokens"] = pa.array(count, pa.int64())
            if "ids_sha256" in want:
                made["ids_sha256"] = sha([b[:-1] for b in tok.decimal.take(ids, count)])
            if {"decoded", "decoded_sha256"} & set(want):
                back = [b.decode("utf-8", "replace") for b in tok.raw.take(ids, count)]
                made["decoded"] = pa.array(back, pa.string())
                if "decoded_sha256" in want:
                    made["decoded_sha256"] = sha([b.encode() for b in back])
            yield pa.RecordBatch.from_arrays([block.column(n) for n in names] + [made[k] for k in want], names=[*names, *want])

    assert not text_too, f"the text column {text!r} can't be replaced"
    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text of their token ids (null or empty ids: the empty text)."""
    path = path or default_path()
    kept = [f for f in df.schema.fields if f.name != into]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec(path)
        for b in batches:
            rows = [x or [] for x in b.column(ids).to_pylist()]
            count = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.fromiter(chain.from_iterable(rows), np.int64, int(count.sum()))
            texts = [t.decode("utf-8", "replace") for t in tok.raw.take(flat, count)]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(texts, pa.string())], names=[*names, into])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(into, T.StringType())]))
