"""Volumes at size: what is shuffled and sorted, read from plans, and results on odd rows."""

from pyspark.sql import functions as F

from mnemo.operators.bleu import clipped_matches, merge_reference_counts, ngram_counts, sentence_bleu
from mnemo.operators.completion import greedy_walk, stored_model, train_next_token
from mnemo.operators.entities import link_entities
from mnemo.operators.matching import fit_idf, tfidf_vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bleu_makes_no_row_per_ngram(spark):
    hyps = spark.createDataFrame([(1, ["a", "b", None, "a"]), (2, ["x"] * 40)], "id long, hyp array<string>")
    refs = spark.createDataFrame([(1, ["a", "b", "c"]), (1, ["a", "a"]), (2, ["x"] * 5), (2, ["x"] * 5)], "id long, ref array<string>")
    out = sentence_bleu(hyps, refs, "id", "hyp", "ref", 2)
    assert "Generate" not in plan(out)
    got = {r.id: [round(p, 6) for p in r.precisions] for r in out.collect()}
    assert got == {1: [0.75, round(1 / 3, 6)], 2: [0.125, round(4 / 39, 6)]}


def test_clipped_matches_sends_texts_only(spark):
    hyps = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["a"]), (2, ["q"]), (None, ["z"])], "id long, hyp array<string>").repartition(4, "id")
    refs = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "a"]), (3, ["q"]), (None, ["z"])], "id long, ref array<string>").repartition(4, "id")
    hc = ngram_counts(hyps, ["id"], "hyp", 2)
    rc = ngram_counts(refs.withColumn("_ref", F.monotonically_increasing_id()), ["id", "_ref"], "ref", 2)
    out = clipped_matches(hc, merge_reference_counts(rc.drop("_ref"), "id"), "id")
    assert plan(out).count("Exchange hashpartitioning") == 2
    assert {(r.id, r.ord): r.matches for r in out.collect()} == {(1, 1): 3, (1, 2): 1}


def test_model_moves_once_and_walks_leave_it(spark):
    corpus = spark.createDataFrame([("a b c d e f a b c d q",), ("a b c d e f",)], "text string")
    model = train_next_token(corpus, 2, min_order=2)
    assert plan(model).count("Exchange hashpartitioning") == 1
    stored = stored_model(model)
    starts = spark.createDataFrame([("a b", 3), ("z z", 2), ("e f", 0)], "start string, need int")
    step = starts.withColumnRenamed("start", "state").hint("shuffle_hash").join(stored, "state")
    assert plan(step).count("Exchange hashpartitioning") == 1
    got = {r.start: r.generated for r in greedy_walk(starts, stored, 2, stored=True).collect()}
    assert got == {"a b": ["c", "d", "e"], "z z": [], "e f": []}


def test_mentions_move_texts_once(spark):
    docs = spark.createDataFrame([(1, "new york city is new"), (2, None), (3, "york")], "doc_id long, text string")
    names = spark.createDataFrame([("new york", "u1", "a,b", 0.5), ("york city", "u2", "", 0.9), ("new", "u3", "c", 1.0), ("new", "u0", "c", 0.1)],
                                  "surface string, uri string, types string, confidence double")
    out = link_entities(docs, names, 2)
    assert plan(out).count("Exchange hashpartitioning") == 1
    got = sorted((r.doc_id, r.pos, r.n_words, r.surface, r.uri, tuple(r.types)) for r in out.collect())
    assert got == [(1, 1, 2, "new york", "u1", ("a", "b")), (1, 2, 2, "york city", "u2", ("",)), (1, 5, 1, "new", "u3", ("c",))]


def test_norm_is_summed_once_a_row(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["c"]), (3, [])], "id long, toks array<string>")
    out = tfidf_vectors(docs, "toks", fit_idf(docs, "toks"))
    text = out._jdf.queryExecution().optimizedPlan().toString()
    # The sum stands outside the lambda over the cells: it is an element of an array, not an operand there.
    assert "/ SQRT(aggregate(" not in text and "/ lambda" in text
    got = {r.id: sum(c["weight"] ** 2 for c in r.vec) for r in out.collect()}
    assert abs(got[1] - 1) < 1e-12 and abs(got[2] - 1) < 1e-12 and got[3] == 0
