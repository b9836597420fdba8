"""Golden values worked out from the published formulas (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from mnemo.functions.patterns import (
    is_line_by_line_sequential,
    is_repeated_text,
    is_repetitive,
    is_sequential_numbers,
)
from mnemo.functions.tokens import memorization_score, snippet
from mnemo.operators.bleu import sentence_bleu
from mnemo.operators.contributions import contributions, threshold_renormalize


def _bleu(spark, refs, hyp, smooth):
    hyps = spark.createDataFrame([(1, [str(x) for x in hyp])], "id long, hyp array<string>")
    rs = spark.createDataFrame([(1, [str(x) for x in r]) for r in refs], "id long, ref array<string>")
    return sentence_bleu(hyps, rs, "id", "hyp", "ref", 4, smooth).first()["bleu"]


@pytest.mark.parametrize(
    "refs,hyp,smooth,expected",
    [
        ([[1, 2, 3, 4, 5]], [1, 2, 3, 4, 6], True, 0.7598356857),
        ([[1, 2, 3, 4, 5]], [1, 2, 3, 4, 6], False, 0.6687403050),
        ([list(range(1, 9))], [1, 2, 3, 4], True, 0.3678794412),
        ([[1, 2]], [1, 2], True, 1.0),
        ([[1, 2]], [1, 2], False, 0.0),
        ([[1, 1, 2], [1, 1, 1, 3]], [1, 1, 1, 1], True, 0.6687403050),
    ],
)
def test_bleu_goldens(spark, refs, hyp, smooth, expected):
    assert _bleu(spark, refs, hyp, smooth) == pytest.approx(expected, abs=1e-9)


def test_bleu_empty_candidate_is_null(spark):
    assert _bleu(spark, [[1, 2]], [], True) is None


def test_memorization_score(spark):
    df = spark.createDataFrame([(["1", "2", "3", "4"], ["1", "9", "3", "8"]), (["1", "2"], ["1", "2", "3", "4"])],
                               "g array<string>, t array<string>")
    got = [r[0] for r in df.select(memorization_score("g", "t", 4)).collect()]
    assert got == [0.5, 0.5]


def test_snippet(spark):
    df = spark.createDataFrame([("a" * 200,), ("b" * 201,)], "t string")
    got = [r[0] for r in df.select(snippet("t")).collect()]
    assert got == ["a" * 200, "b" * 200 + "..."]


@pytest.mark.parametrize(
    "text,completion,rule,expected",
    [
        ("a 1 b 2", "3 4 5", is_sequential_numbers, True),
        ("x 9", "20 21", is_sequential_numbers, True),
        ("x 9", "20", is_sequential_numbers, False),
        ("no digits", "1 2", is_sequential_numbers, False),
        ("l 1\nl 2\nl 3", "l 4\nl 5", is_line_by_line_sequential, True),
        ("l 1\nl 2", "l 3\nm 9", is_line_by_line_sequential, True),
        ("l 1\nl 5", "l 9\nl 13", is_line_by_line_sequential, True),
        ("l 1", "l 2\nl 3", is_line_by_line_sequential, False),
        ("the cat sat on", "x cat sat on y", is_repeated_text, True),
        ("a b c", "xa b cy", is_repeated_text, True),
        ("  ", "z", is_repeated_text, True),
        ("....", ". . .", is_repeated_text, True),
    ],
)
def test_pattern_rules(spark, text, completion, rule, expected):
    df = spark.createDataFrame([(text, completion)], "text string, completion string")
    assert df.select(rule("text", "completion")).first()[0] is expected


@pytest.mark.parametrize("s,expected", [("ababab", True), ("abc", False), ("abcdef", False)])
def test_repetitive(spark, s, expected):
    df = spark.createDataFrame([(s,)], "s string")
    assert df.select(is_repetitive("s")).first()[0] is expected


def _shares(spark, parts, whole, eps):
    p = spark.createDataFrame([(1, "part", i, [float(x) for x in v]) for i, v in enumerate(parts)],
                              "group int, kind string, part_id long, vec array<double>")
    w = spark.createDataFrame([(1, [float(x) for x in whole])], "group int, vec array<double>")
    return [r["share"] for r in contributions(p, w, "group", 1, eps).orderBy("part_id").collect()]


def test_contributions_goldens(spark):
    assert _shares(spark, [[1, 0], [0, 1]], [1, 1], 0.0) == pytest.approx([0.5, 0.5])
    assert _shares(spark, [[3, 0], [0, 1]], [3, 1], 0.0) == pytest.approx([0.75, 0.25])
    assert _shares(spark, [[4, 1], [-1, 0]], [3, 1], 1e-6) == pytest.approx([0.9999966667, 0.0000033333], abs=1e-9)


def test_threshold_renormalize(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.2), (1, "r", 0.3), (2, "a", 0.1)],
                               "group int, kind string, share double")
    got = {(r["group"], r["kind"]): r["share"] for r in threshold_renormalize(df, 0.3, "group").collect()}
    assert got[(1, "a")] == 1.0 and got[(1, "b")] == 0.0 and got[(1, "r")] == 0.0
    assert got[(2, "a")] is None
