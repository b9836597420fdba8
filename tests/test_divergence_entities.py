"""Row-local BLEU, minimal context, divergence pairs and entity mapping on small tables."""

import pytest
from pyspark.sql import functions as F

from mnemo.functions.bleu import row_bleu
from mnemo.operators.completion import greedy_complete, train_next_token
from mnemo.operators.divergence import divergence_pairs, minimal_context, pair_candidates, prefix_scores
from mnemo.operators.entities import TYPE_RELATION, entity_mapping, link_entities, top_entities, triple_lookup


@pytest.mark.parametrize("ref,hyp,smooth,want", [
    ("1 2 3 4 5", "1 2 3 4 6", True, 0.7598356857), ("1 2 3 4 5", "1 2 3 4 6", False, 0.6687403050),
    ("1 2 3 4 5 6 7 8", "1 2 3 4", True, 0.3678794412), ("1 2", "1 2", True, 1.0), ("1 2", "1 2", False, 0.0), ("1 2", "", True, None)])
def test_row_bleu_goldens(spark, ref, hyp, smooth, want):
    df = spark.createDataFrame([(ref.split(), hyp.split())], "r array<string>, h array<string>")
    got = df.select(row_bleu(F.col("h"), F.col("r"), smooth=smooth).alias("b")).first()["b"]
    assert got == (want if want is None else pytest.approx(want, abs=1e-9))


def test_minimal_context_goldens(spark):
    cases = {1: [(1.0, 0), (0.9, 0), (0.5, 1), (0.2, 1)], 2: [(1.0, 0), (0.5, 0), (0.45, 1), (0.1, 1)],
             3: [(0.95, 0), (0.9, 0), (0.85, 0), (0.8, 0)], 4: [(0.6, 1), (0.5, 0), (0.4, 0), (0.4, 0)], 5: [(1.0, 0), (0.0, 0), (0.0, 1), (0.0, 1)]}
    rows = [(k, 4 - i, ["p"], ["r"], ["g"], s, bool(w)) for k, v in cases.items() for i, (s, w) in enumerate(v)]
    scored = spark.createDataFrame(rows, "doc_id long, length int, prefix array<string>, rest array<string>, generated array<string>, bleu double, next_wrong boolean")
    got = {r.doc_id: (r.diverging_position, r.score_before, r.score_after) for r in minimal_context(scored).collect()}
    assert got == {1: (2, 0.9, 0.5), 2: (1, 0.45, 0.1), 3: (4, 1.0, 1.0), 4: (4, 1.0, 0.6), 5: (4, 1.0, 1.0)}
    with pytest.raises(ValueError):
        minimal_context(scored, metric="other")
    assert minimal_context(scored.limit(0)).count() == 0


def test_prefix_scores_and_pairs(spark):
    model = train_next_token(spark.createDataFrame([("a b c d e f g h",), ("x b q r",), ("x b q r",)], "text string"), 2)
    samples = spark.createDataFrame([(7, ["a", "b", "c"], ["d", "e"]), (8, [], ["d", "e"])], "doc_id long, context array<string>, true_completion array<string>")
    got = {r.length: r for r in prefix_scores(samples, model, 2).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[3].generated == ["d", "e"] and got[3].memorization == 1.0 and not got[3].next_wrong
    assert got[1].generated == ["b", "c", "d", "e"]
    div = spark.createDataFrame([(1, ["m"], ["a", "b"], ["c", "d"]), (2, ["m"], ["a", "b"], ["c", "d"]), (3, ["m"], ["a", "b"], ["a", "d"]),
                                 (4, ["m"], ["a", "b"], ["c", "b"]), (5, ["m"], ["a", "b"], ["c"])],
                                "doc_id long, minimal_context array<string>, next_gt_tokens array<string>, next_generated_tokens array<string>")
    assert {r.doc_id: r.status for r in pair_candidates(div).collect()} == {1: "kept", 2: "kept", 3: "same_next", 4: "same_answer", 5: "missing"}
    assert [tuple(r) for r in divergence_pairs(div).collect()] == [("m a", "m c", "b", "d", 1, 1)]


def test_walks_of_different_lengths(spark):
    """Finished and dead walks keep what they had while others go on past a checkpoint."""
    text = " ".join(f"w{i}" for i in range(40))
    model = train_next_token(spark.createDataFrame([(text,)], "text string"), 2)
    starts = [(1, ["w0", "w1"], 20), (2, ["w36", "w37"], 20), (3, ["none", "here"], 20), (4, ["w3", "w4"], 2)]
    got = {r.id: r.generated for r in greedy_complete(spark.createDataFrame(starts, "id long, ctx array<string>, need int"), model, 2, "ctx", "need").collect()}
    assert got == {1: [f"w{i}" for i in range(2, 22)], 2: ["w38", "w39"], 3: [], 4: ["w5", "w6"]}


def test_entity_mapping(spark):
    docs = spark.createDataFrame([(1, "the New York  Times of New York"), (2, ""), (3, None), (4, "York")], "doc_id long, text string")
    gaz = spark.createDataFrame([("New York", "r/ny", "place,city", 0.9), ("New York Times", "r/nyt", "", 0.8), ("York", "r/y", "place", 0.5),
                                 ("York", "r/other", "", 0.2), ("New", "r/new", "", 0.1)], "surface string, uri string, types string, confidence double")
    mentions = link_entities(docs, gaz)
    got = {(r.doc_id, r.pos): (r.surface, r.uri, r.types) for r in mentions.collect()}
    assert got == {(1, 2): ("New York Times", "r/nyt", [""]), (1, 6): ("New York", "r/ny", ["place", "city"]), (4, 1): ("York", "r/y", ["place"])}
    assert {(r.doc_id, r.pos) for r in top_entities(mentions, 1).collect()} == {(1, 2), (4, 1)}
    triples = spark.createDataFrame([("r/ny", "in", "r/us", False, None), ("r/ny", TYPE_RELATION, "city", False, None), ("r/ny", "name", "Neu", True, "de"),
                                     ("r/ny", "name", "NY", True, "en"), ("r/ny", "pop", "8", True, None), ("r/zz", "in", "r/us", False, None)],
                                    "resource string, relation string, target string, is_literal boolean, lang string")
    found = triple_lookup(mentions, triples)
    assert {tuple(r) for r in found.collect()} == {("r/ny", "in", "r/us"), ("r/ny", "name", "NY"), ("r/ny", "pop", "8")}
    assert triple_lookup(mentions, triples, 1).count() == 1
    out = {r.doc_id: r for r in entity_mapping(docs, mentions, found).collect()}
    assert [e.text for e in out[1].entities] == ["New York Times", "New York"] and list(out[1].relations) == ["New York"]
    assert len(out[1].relations["New York"].relations) == 3
    assert out[2].entities == [] and out[2].relations == {} and out[2].text_snippet is None and out[3].text_snippet is None
    assert out[4].text_snippet == "York" and out[4].relations == {}
