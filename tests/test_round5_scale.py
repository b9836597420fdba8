"""What is read and sent at size, and results on odd rows: prompts, prefixes of samples, least likely tokens."""

import pytest

from mnemo.functions.tokens import first_tokens, tokenize
from mnemo.operators import corruption
from mnemo.operators.completion import train_next_token
from mnemo.operators.divergence import minimal_context, prefix_scores
from mnemo.operators.memorization import memorization_scores


@pytest.mark.parametrize("n", [0, 1, 3, 50])
def test_first_tokens_are_those_of_the_whole_text(spark, n):
    texts = ["a b  c\td\n e", "  a b c d", "a", "", " \n ", "a b c ", " a b c", None, "\x0ba\x0cb\rc d e f"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(first_tokens("text", n).alias("head"), tokenize("text").alias("all")).collect()
    assert [r["head"] for r in rows] == [None if r["all"] is None else r["all"][:n] for r in rows]


def test_documents_are_read_once_for_scores(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a b c d e"), (2, "a b"), (2, "a b"), (None, "b c d e a"), (3, None)], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    out = memorization_scores(docs, docs, 2, 3, 2)
    assert out.inputFiles() and not any(path in f for f in out.inputFiles())
    got = sorted((str(r.doc_id), r.completion, r.memorization_score, r.status) for r in out.collect())
    assert got == [("1", ["c", "d", "e"], 1.0, "full"), ("2", ["c", "d", "e"], 0.0, "short"), ("2", ["c", "d", "e"], 0.0, "short"),
                   ("3", [], 0.0, "short"), ("None", ["d", "e", "a"], 1.0, "full")]


def test_prefixes_leave_their_texts_behind(spark):
    model = train_next_token(spark.createDataFrame([("a b c d e f",), ("a b x",), ("a b x",)], "text string"), 2)
    rows = [(1, ["a", "b"], ["c", "d"]), (1, ["c", "d"], ["e", "f"]), (None, ["a"], ["b"]), (None, ["q"], ["b"]), (2, [], ["a"]), (3, ["a"], [])]
    samples = spark.createDataFrame(rows, "doc_id long, context array<string>, true_completion array<string>")
    scored = prefix_scores(samples, model, 2)
    got = sorted((str(r.doc_id), r.length, r.prefix, r.rest, r.generated, r.next_wrong) for r in scored.collect())
    assert got == [
        ("1", 1, ["a"], ["b", "c", "d"], ["b", "x"], False), ("1", 1, ["c"], ["d", "e", "f"], ["d", "e", "f"], False),
        ("1", 2, ["a", "b"], ["c", "d"], ["x"], True), ("1", 2, ["c", "d"], ["e", "f"], ["e", "f"], False),
        ("3", 1, ["a"], [], [], True), ("None", 1, ["a"], ["b"], ["b"], False), ("None", 1, ["q"], ["b"], [], True)]
    out = minimal_context(scored)._jdf.queryExecution()
    lines = out.optimizedPlan().toString().split("\n")
    sent = lines[next(i for i, x in enumerate(lines) if "Join LeftOuter, (_start" in x) + 1]
    assert "Project [" in sent and "AS rest" not in sent and "rest#" not in sent
    assert out.executedPlan().toString().count("Exchange hashpartitioning(doc_id") == 1


def test_followers_are_counted_for_open_places_only(spark, monkeypatch):
    texts = [" ".join(f"w{i % 7}{'x' * (i % 3)}" for i in range(200)), "w1x rare w3", "w1x w0"]
    written = {}

    def noting(df, name):
        out = corruption_materialized(df, name)
        written[name] = out.count()
        return out

    corruption_materialized = corruption.materialized
    monkeypatch.setattr(corruption, "materialized", noting)
    samples = spark.createDataFrame([(1, ["w1x", "w2", "w3"]), (1, ["w5", "w1x", "w0"]), (2, ["zz", "w0", None, "w1x", "q"])], "doc_id long, tokens array<string>")
    got = corruption.corrupt_token_candidates(samples, spark.createDataFrame([(t,) for t in texts], "text string"), 2).collect()
    # The rarest token follows w1x alone; its followers are rare, w0 and w2xx.
    assert written["states-before-rarest"] == 1 and written["followers"] <= 4
    other = {(r.position, r.token): r.candidate for r in got if r.candidate != "rare"}
    assert len(got) == 8 and set(other) == {(1, "w2"), (2, "w0"), (4, "q")}
