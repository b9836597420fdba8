"""Classify (text, completion) rows as trivial patterns and split kept / filtered.

All rules but one are JVM expressions. The skeleton similarity (O72) is a Ratcliff-Obershelp
ratio over Python's printed list of line skeletons, so it runs in an Arrow ``pandas_udf``;
it is fed NULL for rows an earlier rule already decided, so Python only does real work on the
rows that are still undecided.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import (
    is_line_by_line_sequential,
    is_repeated_text,
    is_sequential_numbers,
    lines,
    non_latin,
    py_strip,
    script_of,
    script_repetition,
    skeleton_lines,
    structure_density_hit,
)


@F.pandas_udf(T.DoubleType())
def skeleton_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """SequenceMatcher ratio of the printed skeleton lists (NULL in -> NULL out)."""
    from difflib import SequenceMatcher

    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        sx, sy = str([str(v) for v in x]), str([str(v) for v in y])
        out.append(SequenceMatcher(None, sx, sy).ratio())
    return pd.Series(out, dtype="float64")


#: Skeletons more alike than this make a pair a simple structure.
SIMILAR = 0.8


@F.pandas_udf(T.BooleanType())
def similar_skeletons(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether ``skeleton_similarity`` is over ``SIMILAR`` (NULL in -> NULL out). Its two upper bounds come first: lengths, then counts of characters."""
    from difflib import SequenceMatcher

    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        sx, sy = str([str(v) for v in x]), str([str(v) for v in y])
        m = None
        if 2.0 * min(len(sx), len(sy)) / (len(sx) + len(sy)) > SIMILAR:
            m = SequenceMatcher(None, sx, sy)
        out.append(m is not None and m.quick_ratio() > SIMILAR and m.ratio() > SIMILAR)
    return pd.Series(out, dtype="object")


def cheap_rule(text, completion) -> Column:
    """First matching JVM-side rule, in the reference order; NULL when none matches."""
    return F.coalesce(
        F.when(is_sequential_numbers(text, completion), F.lit("sequential_numbers")),
        F.when(is_line_by_line_sequential(text, completion), F.lit("line_by_line_sequential")),
        F.when(is_repeated_text(text, completion), F.lit("repeated_text")),
        F.when(
            structure_density_hit(text, completion) | script_repetition(text, completion),
            F.lit("simple_structure"),
        ),
    )


def classify(df: DataFrame, text: str = "text", completion: str = "completion", similar: bool = True) -> DataFrame:
    """Adds ``rule`` (first matching rule name, NULL = keep) in one pass.

    Without ``similar`` the last arm, the similarity of line skeletons, is left out and all work stays in the JVM.
    """
    t, c = F.col(text), F.col(completion)
    if not similar:
        return df.withColumn("rule", cheap_rule(t, c))
    staged = df.withColumn("_cheap", cheap_rule(t, c))
    multi = (F.size(lines(py_strip(t))) >= 2) & (F.size(lines(py_strip(c))) >= 2)
    undecided = F.col("_cheap").isNull() & multi
    sim = similar_skeletons(
        F.when(undecided, skeleton_lines(t)), F.when(undecided, skeleton_lines(c))
    )
    out = staged.withColumn(
        "rule", F.coalesce(F.col("_cheap"), F.when(sim, F.lit("simple_structure")))
    )
    return out.drop("_cheap")


def filter_samples(df: DataFrame, text: str = "text", completion: str = "completion"):
    """(kept, filtered) DataFrames from one classified pass."""
    classified = classify(df, text, completion)
    return classified.where(F.col("rule").isNull()).drop("rule"), classified.where(F.col("rule").isNotNull())


def filter_summary(classified: DataFrame, rule_col: str = "rule") -> DataFrame:
    """Total, filtered, kept and filtered percentage (NULL on empty input)."""
    return classified.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(rule_col).isNotNull()).alias("filtered"),
        F.count_if(F.col(rule_col).isNull()).alias("kept"),
    ).withColumn("filtered_pct", F.round(F.try_divide(F.col("filtered") * 100.0, F.col("total")), 6))


def script_histogram(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """O73, aggregated: ``(id, script, n)`` of the characters beyond ASCII; rows without any have no row."""
    chars = df.select(id_col, F.explode(F.split(non_latin(text), "")).alias("_c")).where("_c <> ''")
    return chars.groupBy(id_col, script_of(F.col("_c")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


def middle_split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Test pairs from documents: lines before / after the middle line as (text, completion)."""
    ls = F.split(F.col(text_col), "\n")
    k = F.floor(F.size(ls) / 2).cast("int")
    return docs.select(
        F.col(id_col).alias("row_id"),
        F.array_join(F.slice(ls, 1, k), "\n").alias("text"),
        F.array_join(F.slice(ls, k + 1, F.size(ls) - k), "\n").alias("completion"),
    )
