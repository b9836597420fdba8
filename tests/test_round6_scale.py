"""The stand-in model at size: parts that grow with its texts, texts that stay where they lie, and results on odd rows."""

import re

from mnemo.operators import completion
from mnemo.operators.completion import greedy_walk, train_next_token
from mnemo.operators.memorization import memorization_scores
from mnemo.plans import q_scores

TEXTS = [*["a b c d e f", "x y a b q", " a\tb  c "] * 3, *[f"w{i} a b c{i} d e{i}" for i in range(30)], "a", "", None, "é ü a b"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def corpus_of(spark):
    return spark.createDataFrame([(None if i == 4 else i // 2, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


def rows(df):
    return sorted(map(str, df.collect()))


def test_parts_of_the_model_grow_with_its_texts(spark, monkeypatch):
    corpus, least = corpus_of(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = spark.createDataFrame([("a",), ("zz",)], "token string")
    cases = [{"min_order": 1}, {"min_order": 3}, {"min_order": 3, "heads": heads}]
    one = [rows(train_next_token(corpus, 3, **c)) for c in cases]
    monkeypatch.setattr(completion, "PART_BYTES", 32, raising=False)
    size = sum(len(t.encode()) for t in TEXTS if t)
    for case, orders, known in zip(cases, (2, 1, 2), one):
        model = train_next_token(corpus, 3, **case)
        parts = -(-orders * size // 32)
        assert parts > least and re.findall(r"hashpartitioning\(state#\d+, (\d+)\), REPARTITION", plan(model)) == [str(parts)]
        assert rows(model) == known


def test_scores_by_a_model_of_many_parts(spark, monkeypatch):
    docs = corpus_of(spark)
    known = rows(memorization_scores(docs, docs, 2, 3, 3))
    monkeypatch.setattr(completion, "PART_BYTES", 32, raising=False)
    stored = []
    monkeypatch.setattr(completion, "bucketed", lambda *a, f=completion.bucketed: stored.append(f(*a)) or stored[-1])
    assert rows(memorization_scores(docs, docs, 2, 3, 3)) == known
    buckets = {re.search(r"_(\d{5})\.", f).group(1) for f in stored[0].inputFiles()}
    assert len(buckets) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows(memorization_scores(spark.createDataFrame([], docs.schema), docs.where("false"), 2, 3, 3)) == []


def test_walks_deal_an_unwritten_model_by_its_states(spark, monkeypatch):
    model = train_next_token(corpus_of(spark), 2)
    starts = spark.createDataFrame([("a b", 3), ("zz", 2), ("a", 2), (None, 1)], "start string, need int")
    known = rows(greedy_walk(starts, model, 2))
    monkeypatch.setattr(completion, "PART_STATES", 2, raising=False)
    stored = []
    monkeypatch.setattr(completion, "bucketed", lambda *a, f=completion.bucketed: stored.append(f(*a)) or stored[-1])
    assert rows(greedy_walk(starts, model, 2)) == known
    assert len(stored[0].inputFiles()) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_of_the_model_stay_where_they_lie(spark, monkeypatch, tmp_path):
    corpus_of(spark).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(0, 1), (0, 1), (1, 0), (3, None), (None, 1), (5, 1), (5, 0), (99, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = q_scores.training_docs(spark, str(tmp_path))
        assert "hashpartitioning(doc_id" not in plan(found)
        known = rows(found)
        assert known == sorted(f"Row(doc_id={i // 2}, text={t!r})" for i, t in enumerate(TEXTS) if i != 4 and i // 2 in (0, 5))
        # Too many ids for every task: texts are dealt by id, same rows.
        monkeypatch.setattr(q_scores, "HELD_IDS", 4, raising=False)
        found = q_scores.training_docs(spark, str(tmp_path))
        assert "hashpartitioning(doc_id" in plan(found) and rows(found) == known
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
