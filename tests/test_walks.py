"""Pointer doubling against the stepwise walk, short prompts, and corrupted sequences against brute force."""

import random
from collections import Counter

import pytest

from mnemo.operators.completion import greedy_complete, greedy_walk, train_next_token
from mnemo.operators.corruption import corrupt_token_candidates
from mnemo.operators.memorization import memorization_scores, prompt_table


def corpus_texts(seed=1, n=40):
    r = random.Random(seed)
    return [" ".join(r.choice("abcdefg") + r.choice(["", "1"]) for _ in range(r.randint(1, 30))) for _ in range(n)]


def counts_of(texts, k):
    c = {}
    for t in texts:
        w = t.split()
        for n in range(1, k + 1):
            for i in range(len(w) - n):
                c.setdefault(tuple(w[i:i + n]), Counter())[w[i + n]] += 1
    return c


def stepwise(model, state, need, k):
    out = []
    while len(out) < need and state in model:
        nxt = min(model[state].items(), key=lambda x: (-x[1], x[0]))[0]
        out.append(nxt)
        state = (*state, nxt)[-k:]
    return out


@pytest.mark.parametrize("k, need", [(1, 1), (2, 7), (3, 50), (2, 64)])
def test_doubling_equals_the_stepwise_walk(spark, k, need):
    texts = corpus_texts()
    counts = counts_of(texts, k)
    model = train_next_token(spark.createDataFrame([(t,) for t in texts], "text string"), k)
    r = random.Random(k)
    starts = [(s, r.randint(0, need)) for s in {*list(counts)[:60], ("zz",), ("a", "zz")[:k]}]
    rows = [(" ".join(s), n) for s, n in starts]
    got = {x.start: x.generated for x in greedy_walk(spark.createDataFrame(rows, "start string, need int"), model, k).collect()}
    assert got == {" ".join(s): stepwise(counts, s, n, k) for s, n in starts}


def test_copies_share_walks_and_empty_prompts_have_none(spark):
    model = train_next_token(spark.createDataFrame([("a b c a b c a",)], "text string"), 2)
    prompts = spark.createDataFrame([(1, ["x", "a", "b"], 5), (2, ["a", "b"], 2), (3, [], 4), (4, ["a"], 0), (5, ["q"], 3), (1, ["a", "b"], 3)], "id long, ctx array<string>, need int")
    got = sorted((x.id, x.generated) for x in greedy_complete(prompts, model, 2, "ctx", "need").collect())
    assert got == [(1, ["c", "a", "b"]), (1, ["c", "a", "b", "c", "a"]), (2, ["c", "a"]), (3, []), (4, []), (5, [])]


def test_short_documents_stay_with_a_status(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c"), (3, "a"), (4, ""), (5, None)], "doc_id long, text string")
    rows = {r.doc_id: (r.context, r.true_completion, r.status) for r in prompt_table(docs, 2, 3).collect()}
    assert rows == {1: (["a", "b"], ["c", "d", "e"], "full"), 2: (["a", "b"], ["c"], "short"), 3: (["a"], [], "short"), 4: ([], [], "short"), 5: ([], [], "short")}
    scores = {r.doc_id: r.memorization_score for r in memorization_scores(docs, docs, 2, 3, 2).collect()}
    assert scores == {1: 1.0, 2: pytest.approx(1 / 3), 3: 0.0, 4: 0.0, 5: 0.0}


def corrupted(texts, samples, k):
    counts, single = counts_of(texts, k), Counter(w for t in texts for w in t.split())
    out = []
    for key, tokens in samples:
        for p in range(1, len(tokens or [])):
            state = next((s for n in range(min(p, k), 0, -1) if (s := tuple(tokens[p - n:p])) in counts), None)
            seen = counts.get(state, {})
            best = min(single, key=lambda t: (seen.get(t, 0), single[t], t))
            out.append((key, p, tokens[p], best, [*tokens[:p], best, *tokens[p + 1:]]))
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 3])
def test_least_likely_tokens_equal_brute_force(spark, k):
    texts = [*corpus_texts(5, 12), "a b a c a d a a", ""]
    samples = [(i, t.split()) for i, t in enumerate(corpus_texts(6, 10))] + [(90, ["zz", "a", "b"]), (91, ["a"]), (92, []), (93, None), (0, ["a", "b"])]
    got = corrupt_token_candidates(spark.createDataFrame(samples, "doc_id long, tokens array<string>"),
                                   spark.createDataFrame([(t,) for t in texts], "text string"), k).collect()
    assert sorted(((r.doc_id, r.position, r.token, r.candidate, r.corrupted) for r in got), key=str) == corrupted(texts, samples, k)


def test_all_tokens_follow_a_state(spark):
    texts = ["a a b a b a c a c a c"]
    samples = [(1, ["a", "x"])]
    got = corrupt_token_candidates(spark.createDataFrame(samples, "doc_id long, tokens array<string>"), spark.createDataFrame([(texts[0],)], "text string"), 1).collect()
    assert [(r.candidate, r.corrupted) for r in got] == [("a", ["a", "a"])]


def test_empty_corpus_and_samples(spark):
    none = spark.createDataFrame([], "text string")
    some = spark.createDataFrame([(1, ["a", "b"])], "doc_id long, tokens array<string>")
    assert corrupt_token_candidates(some, none).count() == 0
    assert corrupt_token_candidates(some.where("false"), spark.createDataFrame([("a b",)], "text string")).count() == 0


def test_short_contexts_are_learned_as_far_as_they_occur(spark):
    texts = corpus_texts(8, 20)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, "a", "b c", "zz", "", None])], "doc_id long, text string")
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = counts_of(texts, 3)
    got = {r.doc_id: r.completion for r in memorization_scores(docs, train, 4, 6, 3).collect()}
    assert got == {k: stepwise(counts, tuple((t or "").split()[:4][-3:]), 6, 3) for k, t in enumerate([*texts, "a", "b c", "zz", "", None])}
