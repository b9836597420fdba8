"""Filter interaction audit against a plain count over rows and orders, edge rows, and its packed counters."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from mnemo.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, mask int, digest string, n long, part string, good int"
LABELS = "doc_id long, quality int, toxic int, id int"

LONG = " ".join(f"w{k}" for k in range(120))
TEXTS = [LONG, LONG, LONG + " #", "a b c", "", None, "SHOUT " * 130, ("same words here " * 50), LONG.upper(), "x|y", "  \t\n\x0b\f\r ", "é" * 50 + " É", LONG, "a b c", "",
         " ".join(f"{k}\x1c{k}" for k in range(100)), "W" * 30_000, ("w " * 40_000)]


def doc_rows():
    out = [(k, t, ["en", "de", None, "", "fr"][k % 5], 7, "x", 1, "p", None) for k, t in enumerate(TEXTS)]
    return [*out, out[0], out[12], (12, LONG, "de", 7, None, None, None, 1), (None, LONG, "en", 7, None, None, None, 1), (None, "", "it", None, None, None, None, 1),
            (40, "only here " + LONG, "xx", None, None, None, None, None)]


def label_rows():
    out = [(k, [1, 0, None][k % 3], [0, 1, 1, None][k % 4], 9) for k in range(0, 18) if k != 5]
    return [*out, (1, 1, 0, 9), (1, None, None, 9), (None, 1, 1, 9), (99, 1, 1, 9)]


def brute(docs, labels):
    good = {d for d, q, _, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t, _ in labels if t == 1 and d is not None}
    rows = []
    for d, t, part, *_ in docs:
        t = t or ""
        w = WORD.findall(t)
        f = set()
        f |= {"A"} if len(w) < 100 else set()
        f |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if d is not None and any(o[0] is not None and o[0] < d and (o[1] or "") == t for o in docs) else set()
        rows.append((part or "", f, d in good, d in toxic))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            for s in range(5):
                out[part, order, s + 1] = [0] * 6
        for part, f, g, x in rows:
            gone = False
            for s, c in enumerate(order):
                o = out[part, order, s + 1]
                fails = c in f
                o[0] += not gone and not fails
                o[1] += fails and not gone
                o[2] += fails and gone
                o[3] += f == {c}
                o[4] += fails and not gone and g
                o[5] += fails and not gone and x
                gone = gone or fails
    total = defaultdict(int)
    for (part, order, s), o in out.items():
        total[part, order[s - 1]] += o[1]
    return {(p, o, s): (*v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_every_order_against_plain_counts(spark):
    docs = spark.createDataFrame(doc_rows(), DOCS).repartition(3)
    labels = spark.createDataFrame(label_rows(), LABELS)
    out = filter_audit.audited(docs, labels)
    rows = got(out)
    assert out.count() == len(rows) == 600 * 6
    assert rows == brute(doc_rows(), label_rows())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audited(docs, labels).count() == 0
    some = spark.createDataFrame(doc_rows(), DOCS)
    assert got(filter_audit.audited(some, labels)) == brute(doc_rows(), [])


def test_one_text_of_all_rows(spark):
    docs = spark.createDataFrame([(k, LONG, "en") for k in range(3000)], "doc_id long, text string, lang string")
    rows = got(filter_audit.audited(docs, spark.createDataFrame([], LABELS)))
    assert {(s, v[0], v[1]) for (_, o, s), v in rows.items() if o == "EABCD"} == {(1, 1, 2999), (2, 1, 0), (3, 1, 0), (4, 1, 0), (5, 1, 0)}
    assert rows["en", "ABCDE", 5] == (1, 2999, 0, 2999, 0, 0, 120 * 2999)


@pytest.mark.parametrize("times", [1, 255, 256, 65_535, (1 << 40) + 3, (1 << 62) + 1])
def test_fields_never_run_over(times):
    a, b = filter_audit.outcomes(0, True, True), filter_audit.outcomes(19, True, False)
    width = ((2 * times).bit_length() + 7) // 8
    total = times * filter_audit.packed(a, width) + times * filter_audit.packed(b, width)
    assert np.array_equal(filter_audit.unpacked(total, width, len(a)), times * (a.astype(np.int64) + b))
