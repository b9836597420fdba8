"""Filter interaction audit: what five filters remove in every order, by wide packed counters.

A document's outcome at any of the 600 (order, step) places depends only on the set of filters it fails,
its mask. Every (mask, good, toxic) therefore maps to one big integer with a field a place and kind of
count; the integers of all documents of a part are added, and the sum is unpacked into the table of all
orders. A field is as wide as the part's number of rows needs, and no field can count a row twice, so no
field runs over into the next.

1. Masks of the filters A to D, and a digest of every whole text, are built-in column functions.
2. Filter E (same text as a smaller id, in the whole table) needs no join back to the documents: equal
   texts agree in A to D, so rows are counted by (text, part, good, toxic), and of each text's rows only
   those with its least id pass. A text that a third of all rows share is combined before each shuffle.
3. Rows with one (part, mask, good, toxic) are equal, so their integers are added as count times integer:
   at most 128 rows a part reach the task that adds them up.

Defined results: a null or empty text has no words (fails A only, and E if a smaller id is empty too). A null
part counts as the part ''. Rows with a null id never fail E, make no other row fail it, and have no labels.
Rows that repeat an id and a text don't fail E through each other. Several label rows of one id: good or toxic
if any says so; null labels say nothing. Texts are the same when their SHA-256 is. An empty table gives an empty
result. Columns besides the named ones are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textops import written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
PLACES = len(ORDERS) * STEPS
KINDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in KINDS) + ", shapley long"


def words_of(text: Column) -> Column:
    """The maximal runs without the six ASCII separators; no regular expression on the way."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, digest, mask) of every row: bits 1, 2, 4, 8 of ``mask`` for failing A, B, C, D."""
    t = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    w = t.select("id", "part", "t", words_of(F.col("t")).alias("w")).select(
        "id", "part", "t", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("distinct"))
    fails = [
        F.col("n") < 100,
        100 * F.col("distinct") < 80 * F.col("n"),
        100 * F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long") > 10 * F.length("t").cast("long"),
        F.col("t").rlike("[#$%&*|]"),
    ]
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    return w.select("id", "part", F.sha2(F.col("t").cast("binary"), 256).alias("digest"), mask.alias("mask"))


def counted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of each kind there are, E (bit 16) included."""
    rows = written(masks(docs, key, text, part), "audit-masks")
    marks = labels.select(F.col(key).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id is not null").groupBy(
        "id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    kind = ["part", "mask", "good", "toxic"]
    known = rows.where("id is not null").join(marks, "id", "left").fillna(False, ["good", "toxic"])
    by_id = known.groupBy("digest", "id", *kind).agg(F.count(F.lit(1)).alias("n"))
    by_text = by_id.groupBy("digest", *kind).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"))
    first = F.min("least").over(Window.partitionBy("digest"))
    passing = F.when(F.col("least") == first, F.col("n_least")).otherwise(0)
    split = by_text.select(*kind, F.col("n"), passing.alias("passing")).select(
        "part", "good", "toxic", F.inline(F.array(
            F.struct(F.col("mask"), F.col("passing").alias("n")),
            F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))))
    nameless = rows.where("id is null").select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "mask", F.lit(1).cast("long").alias("n"))
    return split.unionByName(nameless).where("n > 0").groupBy(*kind).agg(F.sum("n").alias("n"))


def outcomes(mask: int, good: bool, toxic: bool) -> np.ndarray:
    """0 or 1 for each kind and place, by kind, then order, then step."""
    out = np.zeros((len(KINDS), len(ORDERS), STEPS), np.uint8)
    for o, order in enumerate(ORDERS):
        gone = False
        for s, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            fails = bool(mask & bit)
            removed = fails and not gone
            out[:, o, s] = (not gone and not fails, removed, fails and gone, mask == bit, removed and good, removed and toxic)
            gone = gone or fails
    return out.reshape(-1)


def packed(fields: np.ndarray, width: int) -> int:
    """One integer with the fields side by side, ``width`` bytes each."""
    cells = np.zeros((len(fields), width), np.uint8)
    cells[:, 0] = fields
    return int.from_bytes(cells.tobytes(), "little")


def unpacked(value: int, width: int, n: int) -> np.ndarray:
    cells = np.frombuffer(value.to_bytes(n * width, "little"), np.uint8).reshape(n, width)
    padded = np.zeros((n, 8), np.uint8)
    padded[:, :width] = cells
    return padded.view("<i8")[:, 0]


def added_up(group: pd.DataFrame) -> pd.DataFrame:
    """The 600 places of one part from its at most 128 kinds of documents."""
    width = (int(group["n"].sum()).bit_length() + 7) // 8  # no field exceeds the part's number of rows
    total = sum(int(r.n) * packed(outcomes(r.mask, r.good, r.toxic), width) for r in group.itertuples())
    fields = unpacked(total, width, len(KINDS) * PLACES).reshape(len(KINDS), PLACES)
    letters = [letter for order in ORDERS for letter in order]
    out = pd.DataFrame({"part": group["part"].iloc[0], "filter_order": np.repeat(ORDERS, STEPS), "step": np.tile(np.arange(1, STEPS + 1), len(ORDERS))})
    for k, kind in enumerate(KINDS):
        out[kind] = fields[k]
    out["shapley"] = out["removed"].groupby(pd.Series(letters)).transform("sum")
    return out


def audited(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row a part, order and step, zeros included, with the counts of ``KINDS`` and ``shapley``."""
    return counted(docs, labels, key, text, part).groupBy("part").applyInPandas(added_up, SCHEMA)


#: The same table in SQL: one row a document, order and step.
SQL = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), f AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d
), m AS (
  SELECT f.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
          'C': 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(least < f.doc_id, false)} AS fails
  FROM f LEFT JOIN (
    SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
  ) l ON l.doc_id = f.doc_id
), kinds AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), places AS (
  SELECT filter_order, step, filter_order[step] AS c FROM orders, (SELECT unnest(generate_series(1, 5))::INT AS step)
), seen AS (
  SELECT k.part, p.filter_order, p.step, p.c, k.n, k.good, k.toxic, k.fails[p.c] AS fail,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: k.fails[x] AND strpos(p.filter_order, x) < p.step)) > 0 AS gone,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: k.fails[x])) = 1 AS single
  FROM (SELECT part, good, toxic, n, map {'A': fails.A, 'B': fails.B, 'C': fails.C, 'D': fails.D, 'E': fails.E} AS fails FROM kinds) k, places p
), counts AS (
  SELECT part, filter_order, step, c,
         sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN fail AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fail AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fail AND single THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fail AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN fail AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley
FROM counts
"""
