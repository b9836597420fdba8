"""Multi-index hashing: exact within the radius, recall against brute force, ties, repeated rows and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.llm import mih

SCHEMA = "vec_id long, embedding array<float>, code long, block int, query long, v int, radius int, asked int"


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6) for i, v in rows], SCHEMA).repartition(partitions)


def clustered(n, d, seed=1, spread=0.35):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n // 25, d))[r.integers(0, n // 25, n)] + spread * r.normal(size=(n, d))).astype(np.float32)


def brute(rows, asked, k=5):
    """Ids and scores by query; vectors that can't be used left out."""
    width = max((len(v) for _, v in rows if v), default=0)
    ok = [(i, np.array(v, float)) for i, v in rows if v and len(v) == width and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    m = np.stack([v / np.abs(v).max() for _, v in ok]) if ok else np.zeros((0, 1))
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q, (i, _) in enumerate(ok):
        if i is not None and asked(i):
            cos = m @ m[q]
            near = sorted((-round(c, 12), j is None, j or 0) for c, (j, _) in zip(cos, ok) if j != i)[:k]
            out[i] = [(None if none else j, -c) for c, none, j in near]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(found, truth):
    hits = [len({j for j, _ in found.get(q, [])} & {j for j, _ in want}) / len(want) for q, want in truth.items()]
    return float(np.mean(hits))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7, 12, 20])
def test_probing_finds_every_code_within_the_radius(radius):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 62, 40, dtype=np.int64).astype(np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, 24), replace=False))) for _ in range(3000)]
    codes = np.array([base[k % 40] ^ f for k, f in enumerate(flips)], np.uint64)
    block = mih.Block(np.arange(3000), r.normal(size=(3000, 8)), codes, 64)
    for q in base:
        assert sorted(block.within(q, radius)) == np.flatnonzero(np.bitwise_count(codes ^ q) <= radius).tolist()


def test_recall_on_close_and_on_scattered_vectors(spark):
    for vectors in (clustered(3000, 32), np.random.default_rng(2).normal(size=(3000, 64)).astype(np.float32)):
        rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
        found = got(mih.neighbours(frame(spark, rows), F.col("vec_id") % 50 == 0, sample=600, block_rows=700))
        truth = brute(rows, lambda i: i % 50 == 0)
        assert found.keys() == truth.keys() and all(len(v) == 5 for v in found.values())
        assert recall(found, truth) >= 0.95
        for q, near in found.items():  # what is found has exactly its cosine
            for j, score in near:
                a, b = vectors[q].astype(float), vectors[j].astype(float)
                assert abs(score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_recall_on_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    assert recall(got(mih.neighbours(table, F.col("vec_id") % 50 == 0)), brute(rows, lambda i: i % 50 == 0)) >= 0.93


def test_ties_go_to_the_smaller_id_over_all_blocks(spark):
    same = clustered(1000, 16)[0].tolist()
    rows = [(k, same) for k in range(1000)] + [(2000 + k, v.tolist()) for k, v in enumerate(clustered(500, 16, 9))]
    found = got(mih.neighbours(frame(spark, rows), F.col("vec_id") % 500 == 0, sample=300, block_rows=100))
    assert [j for j, _ in found[0]] == [1, 2, 3, 4, 5] and [j for j, _ in found[500]] == [0, 1, 2, 3, 4]


def test_odd_rows(spark):
    good = [(k, v.tolist()) for k, v in enumerate(clustered(100, 4))]
    odd = [(100, None), (150, []), (200, [0.0] * 4), (250, [1.0, None, 0.0, 0.0]), (300, [float("nan"), 1.0, 1.0, 1.0]), (350, [float("inf"), 1.0, 1.0, 1.0]),
           (400, [1.0, 2.0]), (450, [3e38] * 4), (500, [1e-40] * 4), (None, [2e38] * 4), (-50, [-1.0, 0.5, 0.0, 0.0])]
    found = got(mih.neighbours(frame(spark, good + odd), F.col("vec_id") % 50 == 0, sample=60))
    truth = brute(good + odd, lambda i: i % 50 == 0)
    assert found.keys() == truth.keys() == {0, 50, 450, 500, -50}
    assert recall(found, truth) >= 0.9
    assert found[450][0][0] == 500 and found[450][1][0] is None and found[450][0][1] == pytest.approx(1)


def test_few_and_repeated_rows(spark):
    assert mih.neighbours(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert mih.neighbours(frame(spark, [(0, [1.0, 0.0])]), F.col("vec_id") % 50 == 0).count() == 0
    three = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    assert [j for j, _ in got(mih.neighbours(frame(spark, three), F.col("vec_id") == 0))[0]] == [2, 1]
    # each row of a repeated id asks by itself, and none of them is found by it; repeated candidates are each found
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    out = mih.neighbours(frame(spark, rows), F.col("vec_id") == 0, k=2).collect()
    assert sorted((r.rank, r.id) for r in out) == [(1, 1), (1, 2), (2, 1), (2, 1)]
