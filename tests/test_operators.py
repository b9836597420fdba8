"""Operator properties on small in-memory tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.operators import matching
from mnemo.operators.circuits import kl_to_clean, logit_diff, ranked_scores, smallest_prefix
from mnemo.operators.completion import greedy_complete, train_next_token
from mnemo.operators.graph import best_to_target
from mnemo.operators.matching import greedy_match
from mnemo.operators.relational import contiguous_shards, global_rank, train_test_split


def test_global_rank_and_shards(spark):
    df = spark.range(0, 10).withColumnRenamed("id", "k")
    r = global_rank(df, ["k"], "r").orderBy("k").collect()
    assert [x["r"] for x in r] == list(range(1, 11))
    s = contiguous_shards(df, 3, ["k"]).groupBy("shard").count().orderBy("shard").collect()
    assert [x["count"] for x in s] == [3, 3, 4]


def test_train_test_split_exact(spark):
    df = spark.range(0, 25).withColumnRenamed("id", "k")
    s = train_test_split(df, "k", 0.1, 42)
    assert s.where(F.col("split") == "test").count() == 2
    assert s.count() == 25


def test_greedy_walk_matches_stepwise(spark):
    corpus = spark.createDataFrame([("a b c d a b c e a b c d",)], "text string")
    model = train_next_token(corpus, 2)
    prompts = spark.createDataFrame([(1, ["a", "b"])], "id long, ctx array<string>")
    got = greedy_complete(prompts, model, 2, "ctx", 5).first()["generated"]
    # a b -> c (c follows 'a b' 3 times); b c -> d (2 vs 1); c d -> a; d a -> b; a b -> c
    assert got == ["c", "d", "a", "b", "c"]


def _side(spark, name, rows):
    return spark.createDataFrame(rows, f"{name} long, vec array<double>, n long")


def _serial_match(highs, lows, same):
    used, out = set(), set()
    for h, hv, hn in highs:
        sims = [(-round(sum(a * b for a, b in zip(hv, lv)) / (math.hypot(*hv) * math.hypot(*lv)), 12), low, ln)
                for low, lv, ln in lows if low not in used]
        if sims:
            _, low, ln = min(sims)
            if not same or ln == hn:
                used.add(low)
                out.add((h, low))
    return out


@pytest.mark.parametrize("same", [None, "n"])
def test_greedy_match_equals_the_serial_walk(spark, same):
    rnd = random.Random(3)
    highs = [(i, [rnd.gauss(0, 1) for _ in range(3)], rnd.randrange(3)) for i in range(60)]
    lows = [(i, [rnd.gauss(0, 1) for _ in range(3)], rnd.randrange(3)) for i in range(70)]
    lows += [(100 + i, v, n) for i, v, n in lows[:10]]  # equal vectors tie, the lower id goes first
    got = greedy_match(_side(spark, "high_id", highs), _side(spark, "low_id", lows), same=same, k=8)
    assert {(r[0], r[1]) for r in got.collect()} == _serial_match(highs, lows, same)


def test_greedy_match_more_highs_than_lows_and_none(spark):
    highs, lows = [(i, [1.0, 0.1 * i], 0) for i in range(5)], [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)]
    got = greedy_match(_side(spark, "high_id", highs), _side(spark, "low_id", lows))
    assert {(r[0], r[1]) for r in got.collect()} == {(0, 0), (1, 1)}
    assert greedy_match(_side(spark, "high_id", []), _side(spark, "low_id", lows)).count() == 0
    assert greedy_match(_side(spark, "high_id", highs), _side(spark, "low_id", [])).count() == 0


def test_top_k_similar_of_3000_highs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_BYTES", 8 * 4 * 1200)
    rng = np.random.default_rng(5)
    hm, lm = rng.normal(size=(3000, 4)), rng.normal(size=(500, 4))
    highs, lows = [(i, v.tolist(), 0) for i, v in enumerate(hm)], [(i, v.tolist(), 0) for i, v in enumerate(lm)]
    got = matching.top_k_similar(_side(spark, "high_id", highs), _side(spark, "low_id", lows), k=2).collect()
    sims = (hm / np.linalg.norm(hm, axis=1)[:, None]) @ (lm / np.linalg.norm(lm, axis=1)[:, None]).T
    best = np.argsort(-sims, axis=1)[:, :2]
    assert {(r["high_id"], r["rank"]): r["low_id"] for r in got} == {(i, j + 1): int(best[i, j]) for i in range(3000) for j in range(2)}


def test_best_path_golden(spark):
    e = spark.createDataFrame(
        [(1, "X", "A", 0, 1, 0.5), (1, "X", "B", 0, 1, 0.2), (1, "A", "T", 1, 2, 0.1), (1, "B", "T", 1, 2, 0.9)],
        "graph_id long, src string, dst string, src_level int, dst_level int, weight double")
    t = spark.createDataFrame([(1, "T", 2)], "graph_id long, node string, level int")
    best = {r["node"]: (r["score"], r["path"]) for r in best_to_target(e, t, 0.0).collect()}
    assert best["X"][1] == "X,B,T" and abs(best["X"][0] - 1.1) < 1e-12
    best = {r["node"] for r in best_to_target(e, t, 0.3).collect()}
    assert "X" not in best


def test_kl_and_logit_diff(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 1.0, 1.0], [0.1, 0.7, 0.2])], "x array<double>, c array<double>, l array<double>")
    r = df.select(kl_to_clean(F.col("x"), F.col("c")).alias("kl"),
                  logit_diff(F.col("l"), F.lit(1), F.lit(2)).alias("d")).first()
    assert abs(r["kl"] - 0.1029978919) < 1e-9
    assert abs(r["d"] - 0.5) < 1e-12


def test_smallest_prefix(spark):
    e = spark.createDataFrame([(i, float(s)) for i, s in enumerate([5, 3, 1, 1])], "edge_id long, score double")
    assert smallest_prefix(ranked_scores(e, "score", ["edge_id"]), 0.8).first()["n"] == 2


def test_average_by_position_reads_all_rows(spark):
    from mnemo.plans.catalog import load_all

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()
    got = {r.pos: (r.avg_value, r.n_values) for r in load_all()["average_by_position_all"].fn(spark, sf).collect()}
    for pos in range(33):
        values = [float(r.embedding[pos]) for r in rows if len(r.embedding) > pos]
        assert got[pos][1] == len(values)
        assert abs(got[pos][0] - (sum(values) / len(values) if values else 0.0)) < 2e-6


def test_prompt_split_keeps_short_documents(spark):
    from mnemo.operators.memorization import prompt_table_all

    texts = [None, "", "a b", "a b c", "a b c d", "a b c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.context, r.true_completion, r.status) for r in prompt_table_all(docs, 2, 2).orderBy("doc_id").collect()]
    assert got == [([], [], "short"), ([], [], "short"), (["a", "b"], [], "short"), (["a", "b"], ["c"], "short"),
                   (["a", "b"], ["c", "d"], "full"), (["a", "b"], ["c", "d"], "full")]
