"""Walks that follow texts: results equal the walk token by token, and the model is read once a round."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.functions.bleu import row_bleu
from mnemo import session
from mnemo.operators import completion, corruption, matching, pipeline, tokens
from mnemo.operators.completion import greedy_walk, stored_model, stored_texts, train_next_token
from mnemo.operators.divergence import prefix_scores
from mnemo.sources import io

SAMPLES = "doc_id long, context array<string>, true_completion array<string>"


def corpus_texts(seed, n=30):
    r = random.Random(seed)
    return [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 40))) for _ in range(n)] + ["x y x y x y q", "", None, " m \t n  o p\n", "é ü é ü w"] * 2


def chosen(texts, k):
    counts = {}
    for t in texts:
        w = (t or "").split()
        for n in range(1, k + 1):
            for i in range(len(w) - n):
                counts.setdefault(tuple(w[i:i + n]), Counter())[w[i + n]] += 1
    return {s: min(c.items(), key=lambda x: (-x[1], x[0]))[0] for s, c in counts.items()}


def walk(model, tokens, need, k):
    out, state = [], tuple(tokens[-k:])
    while len(out) < need and state in model:
        out.append(model[state])
        state = (*state, out[-1])[-k:]
    return out


def trained(spark, texts, k, parts=3):
    rows = stored_texts(spark.createDataFrame([(t,) for t in texts], "text string"))
    return stored_model(train_next_token(rows, k, parts=parts, row_col="text_row"), parts), rows


@pytest.mark.parametrize("k", [1, 2, 3])
def test_walks_along_texts_equal_the_walk_by_tokens(spark, k):
    texts = corpus_texts(k)
    known, (model, rows) = chosen(texts, k), trained(spark, texts, k)
    r = random.Random(k)
    starts = [(" ".join(s), r.randint(0, 45)) for s in sorted({*r.sample(sorted(known), min(len(known), 40)), ("x", "y", "x")[:k], ("zz",), ("é", "ü")[:k]})]
    got = greedy_walk(spark.createDataFrame([*starts, (None, 3)], "start string, need int"), model, k, stored=True, texts=rows)
    assert {x.start: x.generated for x in got.collect()} == {s: walk(known, s.split(" "), n, k) for s, n in starts} | {None: []}


def test_a_walk_reads_the_model_once_a_text(spark, monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(60)), *["w30 w31 v0"] * 2, " ".join(f"v{i}" for i in range(40)), "l0 l1 l2 l0 l1 l9", "l2 l0 l1 l2"]
    model, rows = trained(spark, texts, 2)
    folders, scratch = [], completion.scratch_path
    monkeypatch.setattr(completion, "scratch_path", lambda s, n: folders.append(scratch(s, n)) or folders[-1])
    starts = [("w0 w1", 50), ("w2 w3", 40), ("l0 l1", 39)]
    got = {x.start: x.generated for x in greedy_walk(spark.createDataFrame(starts, "start string, need int"), model, 2, stored=True, texts=rows).collect()}
    known = chosen(texts, 2)
    assert got == {s: walk(known, s.split(), n, 2) for s, n in starts} and len(got["l0 l1"]) == 39
    rounds = max(len([x for x in os.listdir(f.removeprefix("file:")) if x.startswith("round=")]) for f in folders)
    assert rounds <= 5


@pytest.mark.parametrize("by_texts", [True, False])
def test_prefixes_equal_brute_force(spark, by_texts):
    texts, k, r = corpus_texts(9), 2, random.Random(2)
    known, (model, rows) = chosen(texts, k), trained(spark, texts, k)
    samples = []
    for i, t in enumerate(t for t in texts if t and len(t.split()) > 3):
        w = t.split()
        cut = r.randint(1, min(len(w), 9))
        samples.append((i // 2, w[:cut], w[cut:cut + 5]))
    samples += [(None, ["a"], ["b"]), (None, ["zz"], ["b", "c"]), (1, ["zz", "a", "b"], ["zz"]), (2, [], ["a"]), (3, ["a"], []), (4, ["a", None, "b"], ["c"]),
                (5, ["a b", "c"], ["d"]), (6, ["x", "y"], ["x", "y", "x", "y", "x", "y"])]
    got = prefix_scores(spark.createDataFrame(samples, SAMPLES), model, k, stored=True, texts=rows if by_texts else None).collect()
    want = []
    for key, context, truth in samples:
        for n in range(1, len(context) + 1):
            whole = context + truth
            state = " ".join(x for x in whole[:n][-k:] if x is not None).split(" ")
            out = walk(known, state, len(whole) - n, len(state)) if len(state) > k else walk(known, state, len(whole) - n, k)
            want.append((key, n, whole[:n], whole[n:], out, not out or not whole[n:] or out[0] != whole[n]))
    assert sorted(map(str, ((x.doc_id, x.length, x.prefix, x.rest, x.generated, x.next_wrong) for x in got))) == sorted(map(str, want))


def test_bleu_in_a_row_numbers_only_what_repeats(spark):
    r = random.Random(3)
    rows = [([r.choice("abcdefgh"[:r.randint(1, 8)]) for _ in range(r.randint(0, 9))], [r.choice("abcde") for _ in range(r.randint(0, 9))]) for _ in range(60)]
    rows += [(x, x) for x, _ in rows[:10]] + [(["a"], ["a"]), ([], []), (None, ["a"]), (["a"], None), (["a", "b"], ["a", "b", "a", "b"])]
    frame = spark.createDataFrame(rows, "h array<string>, r array<string>")
    for smooth in (True, False):
        got = [x.b for x in frame.select(row_bleu(F.col("h"), F.col("r"), smooth=smooth).alias("b")).collect()]
        assert got == [None if x is None else pytest.approx(x, abs=1e-12) for x in (bleu(h, ref, smooth) for h, ref in rows)]
    distinct = row_bleu(F.col("h"), F.col("r"), smooth=True)
    assert "array_distinct" in frame.select(distinct)._jdf.queryExecution().optimizedPlan().toString()


def bleu(hyp, ref, smooth):
    if not hyp or not ref:
        return None
    logs = 0.0
    for n in range(1, 5):
        h, r = (Counter(zip(*(side[i:] for i in range(n)))) for side in (hyp, ref))
        found, possible = sum((h & r).values()), max(len(hyp) - n + 1, 0)
        p = (found + 1) / (possible + 1) if smooth else found / possible if possible else 0.0
        if not p:
            return 0.0
        logs += math.log(p)
    return math.exp(logs / 4) * min(1.0, math.exp(1 - len(ref) / len(hyp)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_pipeline_writes_its_model_once(spark, monkeypatch):
    texts = [(i, t) for i, t in enumerate(corpus_texts(4, 20))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    written, write = [], session.bucketed
    for module in (completion, io):
        monkeypatch.setattr(module, "bucketed", lambda *a: written.append(a[1]) or write(*a))
    folder = session.scratch_path(spark, "chain")

    def run():
        return pipeline.run_pipeline(spark, ("docs", docs), ("train", docs), folder, prompt_tokens=6, generation_tokens=5, k=2, threshold=0.4)

    first = run()
    assert written == ["text_row", "state"]
    known = chosen([t for _, t in texts], 2)
    assert {x.doc_id: x.completion for x in first.tables["scores"].collect()} == {i: walk(known, (t or "").split()[:6], 5, 2) if (t or "").split() else [] for i, t in texts}
    starts = spark.createDataFrame([("a b",)], "state string").hint("shuffle_hash")
    rows = sorted(map(tuple, first.tables["evaluation"].collect()))
    assert rows and plan(starts.join(first.tables["model"], "state")).count("Exchange hashpartitioning") == 1
    for name in [x.name for x in spark.catalog.listTables() if x.name.startswith("mnemo_")]:
        spark.sql(f"DROP TABLE {name}")  # as in another session
    again = run()
    assert again.built == [] and sorted(map(tuple, again.tables["evaluation"].collect())) == rows
    assert plan(starts.join(again.tables["model"], "state")).count("Exchange hashpartitioning") == 1


def test_followers_of_states_send_no_other_pairs(spark, monkeypatch):
    texts = corpus_texts(6)
    corpus = spark.createDataFrame([(t,) for t in texts], "text string")
    asked = spark.createDataFrame([("a b",), ("a b",), ("c",), ("x y x",), ("zz",), (None,)], "state string")
    want = Counter()
    for t in texts:
        w = (t or "").split()
        want.update((" ".join(w[i:i + n]), w[i + n]) for n in (1, 2, 3) for i in range(len(w) - n) if " ".join(w[i:i + n]) in ("a b", "c", "x y x"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for held in (2_000_000, 2):
            monkeypatch.setattr(corruption, "HELD_STATES", held, raising=False)
            found = corruption.followers(corpus, 3, asked)
            assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi, (xxhash64(state") == (2 if held == 2 else 1)
            assert {(r.state, r.next): r.cnt for r in found.collect()} == dict(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_elements_are_looked_up_once_a_chunk(spark, monkeypatch):
    words = [f"w{i % 9}" for i in range(40)]
    rows = [(i // 2, words[i % 7:i % 7 + i % 5], "x") for i in range(60)] + [(None, ["w1", None, "w2"], None), (70, None, "y"), (71, [], "z"), (72, ["new", "w0"], "q"), (73, ["é"] * 3, "é")]
    frame = spark.createDataFrame(rows, "id long, toks array<string>, more string").repartition(3)
    vocab = tokens.dictionary(frame.where("id is null or id < 70"), "toks").cache()
    at = {r.token: r.id for r in vocab.collect()}
    sent, work = spark.sparkContext.accumulator(0), tokens._distinct_elements

    def counted(col):
        def outer(batches, inner=work(col)):
            for b in inner(batches):
                sent.add(b.num_rows)
                yield b

        return outer

    monkeypatch.setattr(tokens, "_distinct_elements", counted, raising=False)
    for limit in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        ids = tokens.encode(frame, "toks", vocab)
        want = [(i, None if t is None else [at.get(x, -1) for x in t], t, m) for i, t, m in rows]
        assert sorted(map(str, ((r.id, r.ids, r.toks, r.more) for r in ids.collect()))) == sorted(map(str, want)) and ids.columns == ["id", "toks", "more", "ids"]
        back = tokens.decode(ids.select("id", "ids"), "ids", vocab, "toks")
        got = sorted(map(str, ((r.id, r.toks) for r in back.collect())))
        assert got == sorted(map(str, ((i, None if t is None else [x if x in at else "<unk>" for x in t]) for i, t, _ in rows)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert 0 < sent.value <= 6 * 3 * 13  # six lookups of the distinct words of three parts; by row there are some 120 each
    monkeypatch.setattr(tokens, "CHUNK_ELEMENTS", 3, raising=False)
    assert sorted(map(str, ((r.id, r.ids, r.toks, r.more) for r in tokens.encode(frame, "toks", vocab).collect()))) == sorted(map(str, want))
    assert tokens.encode(frame.where("false"), "toks", vocab).count() == 0


@pytest.mark.parametrize("wait", [1, 40, 250_000])
def test_found_cells_wait_to_be_sorted(monkeypatch, wait):
    monkeypatch.setattr(matching, "WAIT_CELLS", wait, raising=False)
    r, n, k = np.random.default_rng(4), 5, 3
    sims = np.round(r.integers(0, 12, (n, 400)) / 12, 9)
    ids = r.permutation(400)
    best, sorts, lexsort = matching._Best(n, k, 9), [], np.lexsort
    monkeypatch.setattr(matching.np, "lexsort", lambda *a: sorts.append(1) or lexsort(*a))
    for at in range(0, 400, 2):
        best.add(ids[at:at + 2], sims[:, at:at + 2])
    best.settle()
    got = [[(float(s), int(i)) for row, i, s in zip(best.rows, best.ids, best.sims) if row == x] for x in range(n)]
    assert got == [sorted(zip(sims[x].tolist(), ids.tolist()), key=lambda c: (-c[0], c[1]))[:k] for x in range(n)]
    assert len(sorts) <= -(-n * 400 // max(wait, n * k)) + 1
