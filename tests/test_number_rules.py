"""Number, line and phrase rules: numbers of any length and script, and cost on long rows."""

import re
import time

import pytest

from mnemo.functions.patterns import is_line_by_line_sequential, is_repeated_text, is_sequential_numbers


def _py_sequential(text, completion):
    t, c = ([int(x) for x in re.findall(r"\b(\d+)\b", s)] for s in (text, completion))
    if not t or not c:
        return False
    return all(x == t[-1] + i + 1 for i, x in enumerate(c)) or (len(c) > 1 and all(b == a + 1 for a, b in zip(c, c[1:])))


SEQUENCES = [
    ("id 12345678901234567890 then 7", "8 9"), ("x 99999999999999999999", "100000000000000000000"), ("x \u0663", "\u0664"),
    ("x " + "9" * 60, "1" + "0" * 60), ("x " + "9" * 60, "1" + "0" * 59 + "1"), ("x 1", "5 6 7"), ("x 1", "5 6 8"), ("x 007", "8"),
    ("", "1 2"), ("1", ""), ("x 5", "4"), ("x " + "9" * 18, "1" + "0" * 18), ("x " + "9" * 36, "1" + "0" * 36), ("x 10000000000000000000", "9999999999999999999"),
]


def test_sequential_numbers_equal_python(spark):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(SEQUENCES)], "i int, t string, c string")
    got = {r[0]: r[1] for r in rows.select("i", is_sequential_numbers("t", "c")).collect()}
    assert got == {i: _py_sequential(*p) for i, p in enumerate(SEQUENCES)}
    assert [got[i] for i in range(4)] == [True] * 4


@pytest.mark.parametrize("start, step, off, want", [(1, 1, 0, True), (10**25, 3, 0, True), (10**25, 3, 1, False), (10**40, -7, 0, True), (5, -1, 0, True)])
def test_line_sequences_of_any_length(spark, start, step, off, want):
    text, completion = ("\n".join(f"row {start + step * i}" for i in r) for r in (range(3), range(3, 6)))
    if off:
        completion = "\n".join(f"row {start + step * i + off * i * i}" for i in range(3, 6))
    row = spark.createDataFrame([(text, completion)], "t string, c string")
    assert row.select(is_line_by_line_sequential("t", "c")).first()[0] is want


def test_null_and_empty(spark):
    rows = spark.createDataFrame([(None, "1"), ("1", None), ("", "")], "t string, c string")
    for rule in (is_sequential_numbers, is_line_by_line_sequential, is_repeated_text):
        assert [r[0] for r in rows.select(rule("t", "c")).collect()] == [False] * 3


def test_phrase_inside_longer_words(spark):
    rows = spark.createDataFrame([("at the end", "cat the ending x"), ("at the end", "at them end x"), ("a b c d", "x b c d")], "t string, c string")
    assert [r[0] for r in rows.select(is_repeated_text("t", "c")).collect()] == [True, False, True]


def test_long_rows_are_linear(spark):
    numbered = "\n".join(f"line {i}" for i in range(2000)), "\n".join(f"line {3 * i}" for i in range(2000))
    words = " ".join(f"a{i}" for i in range(20000)), " ".join(f"b{i}" for i in range(20000))
    for rule, pair in ((is_line_by_line_sequential, numbered), (is_repeated_text, words)):
        row = spark.createDataFrame([pair], "t string, c string")
        row.select(rule("t", "c")).first()
        t0 = time.time()
        assert row.select(rule("t", "c")).first()[0] is False
        assert time.time() - t0 < 3
