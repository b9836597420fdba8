"""Rules that scan a text once, walks by blocks of highs, ids looked up by hash."""

import difflib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemo.functions import patterns as P
from mnemo.operators import filtering, matching
from mnemo.operators.tokens import dictionary, encode

from test_operators import _serial_match, _side


def test_non_latin_part_is_found_once(spark):
    said = str(P.script_repetition(F.col("text"), F.col("completion")))
    assert said.count("x7F]+") == 2
    rows = [("абабаб", "вгвгвг"), ("абабаб", "漢字漢字"), ("plain", "абаб"), ("", ""), (None, "абаб"), ("ああ漢", "漢あ漢")]
    got = spark.createDataFrame(rows, "t string, c string").select(
        P.script_repetition("t", "c").alias("same"), P.dominant_script("t").alias("t"), P.dominant_script("c").alias("c")).collect()
    assert [r["same"] for r in got] == [True, False, False, False, False, False]
    assert [r["t"] for r in got] == ["Cyrillic", "Cyrillic", None, None, None, "Hiragana"]
    assert [r["c"] for r in got] == ["Cyrillic", "CJK", "Cyrillic", None, "Cyrillic", "CJK"]


def test_structure_literals_are_in_every_match(spark):
    samples = ["<b>x</b>", "|-\n| a", "1. a", "• a", "* a", "a/b1", " 1. a", "Licensed under the Apache License", "Category:", "![](x)", "[](x)",
               "Copyright 2020", "John 3:16", "&#12;", 'class="a"', "[@bib1]", "<!DOCTYPE", 'xmlns:a="b"']
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    hits = df.select("i", *[P._density(F.col("s"), F.lit(1), k).alias(f"p{k}") for k in range(18)]).collect()
    assert all(r[f"p{r.i}"] for r in hits)


def test_phrase_inside_longer_words(spark):
    rows = [("xx one two three yy", "z gone two threes q"), ("a one two three", "gone xx threes"), ("one two three", "one three two"), ("p q r s", "q r s t")]
    got = spark.createDataFrame(rows, "t string, c string").select(P.is_repeated_text("t", "c").alias("r")).collect()
    assert [r.r for r in got] == [True, False, False, True]


def test_skeletons_too_unlike_are_not_compared(monkeypatch):
    calls = []

    class Matcher(difflib.SequenceMatcher):
        def ratio(self):
            calls.append(len(self.a))
            return super().ratio()

    monkeypatch.setattr(difflib, "SequenceMatcher", Matcher)
    a, b = [["X, X"], ["X" * 500], ["abc!" * 30], None], [["X, X."], ["X"], ["--?/" * 30], ["X"]]
    out = filtering.similar_skeletons.func(pd.Series(a, dtype="object"), pd.Series(b, dtype="object"))
    assert list(out) == [True, False, False, None] and len(calls) == 1


@pytest.mark.parametrize("cells", [40, 250_000])
def test_copies_need_no_round_each(spark, monkeypatch, cells):
    rounds, cut = [], matching.cut_lineage
    monkeypatch.setattr(matching, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    monkeypatch.setattr(matching, "WALK_CELLS", cells)
    rnd = random.Random(5)
    n = 24 if cells > 1000 else 12
    highs = [(i, [1.0, 2.0], 0) for i in range(n)] + [(n + i, [rnd.gauss(0, 1), 1.0], rnd.randrange(2)) for i in range(6)]
    lows = [(i, [1.0, 2.0], 0) for i in range(n)] + [(n + i, [rnd.gauss(0, 1), 1.0], rnd.randrange(2)) for i in range(12)]
    got = matching.greedy_match(_side(spark, "high_id", highs), _side(spark, "low_id", lows), same="n", k=8)
    assert {(r[0], r[1]) for r in got.collect()} == _serial_match(highs, lows, "n")
    if cells > 1000:
        assert len(rounds) <= 14


def test_ids_are_looked_up_without_a_map(spark):
    words = [f"w{i}" for i in range(3000)] * 2
    toks = spark.createDataFrame([(1, words), (2, ["w5", None, "w7"]), (3, None), (4, [])], "id long, toks array<string>")
    vocab = dictionary(toks, "toks").cache()
    ids = encode(toks, "toks", vocab)
    assert "map_from_entries" not in ids._jdf.queryExecution().toString()
    at = {r.token: r.id for r in vocab.collect()}
    assert sorted((r.id, r.ids) for r in ids.collect() if r.id != 3) == [(1, [at[w] for w in words]), (2, [at["w5"], -1, at["w7"]]), (4, [])]


def test_repeated_ids_keep_their_rows(spark):
    highs, lows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0)], [(5, [1.0, 0.0], 0), (6, [0.0, 1.0], 0), (6, [0.0, 1.0], 0)]
    got = matching.greedy_match(_side(spark, "high_id", highs), _side(spark, "low_id", lows))
    assert sorted((r[0], r[1]) for r in got.collect()) == [(1, 5), (1, 5), (2, 6), (2, 6)]
