"""BLEU as DataFrame jobs.

A sample's hypothesis and references meet in one shuffle by sample id, as token arrays. Their n-grams are counted, clipped by
the largest count among the references and summed by order inside the row, so that no row per n-gram is ever sorted,
spilled or shuffled, and a frequent n-gram ("of the") is only ever counted within one sample.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tag(arr: Column, order: int) -> Column:
    return F.transform(arr, lambda g: F.struct(F.lit(order).alias("ord"), g.alias("ngram")))


def _ngram_structs(tokens: Column, max_order: int) -> Column:
    """ARRAY<STRUCT<order INT, ngram STRING>> of all n-grams of orders 1..max_order.

    Order n is built from order n-1 by zipping shifted slices (no per-position slicing).
    """
    size = F.size(tokens)
    outs = []
    prev = None
    for n in range(1, max_order + 1):
        m = F.greatest(size - n + 1, F.lit(0))
        cur = F.slice(tokens, 1, m) if prev is None else F.zip_with(
            F.slice(prev, 1, m), F.slice(tokens, n, m), lambda a, b: F.concat_ws(" ", a, b)
        )
        outs.append(_tag(cur, n))
        prev = cur
    return F.flatten(F.array(*outs))


def ngram_counts(df: DataFrame, keys: list[str], tokens_col: str, max_order: int = 4) -> DataFrame:
    """``(keys..., ord, ngram, cnt)`` — every n-gram of orders 1..N with multiplicity."""
    toks = F.transform(F.col(tokens_col), lambda x: x.cast("string"))
    exploded = df.select(*keys, F.inline(_ngram_structs(toks, max_order)))
    return exploded.groupBy(*keys, "ord", "ngram").agg(F.count(F.lit(1)).alias("cnt"))


def merge_reference_counts(ref_counts: DataFrame, id_col: str) -> DataFrame:
    """Multiset union over references: max count per (sample, n-gram)."""
    return ref_counts.groupBy(id_col, "ord", "ngram").agg(F.max("cnt").alias("ref_cnt"))


def clipped_matches(hyp_counts: DataFrame, ref_max: DataFrame, id_col: str) -> DataFrame:
    """Per (sample, order) sum of min(candidate count, reference max count).

    Either side has one row per (sample, order, n-gram). Both are grouped together rather than joined: sides dealt alike by sample are
    matched where they are.
    """
    keys = [id_col, "ord", "ngram"]
    none = F.lit(None).cast("long")
    sides = hyp_counts.select(*keys, "cnt", none.alias("ref_cnt")).union(ref_max.select(*keys, none.alias("cnt"), "ref_cnt"))
    both = sides.where(F.col(id_col).isNotNull() & F.col("ngram").isNotNull()).groupBy(*keys).agg(F.max("cnt").alias("cnt"), F.max("ref_cnt").alias("ref_cnt"))
    found = both.where(F.col("cnt").isNotNull() & F.col("ref_cnt").isNotNull())
    return found.groupBy(id_col, "ord").agg(F.sum(F.least("cnt", "ref_cnt")).alias("matches"))


def _grams(tokens: list, n: int) -> Counter:
    """N-grams of one order with multiplicity, joined by spaces; null tokens are no 1-grams."""
    if n == 1:
        return Counter(t for t in tokens if t is not None)
    return Counter(" ".join(t for t in g if t is not None) for g in zip(*(tokens[i:] for i in range(n)), strict=False))


def _clipped(hyp: list, refs: list, max_order: int) -> list[int]:
    """Clipped matches of one sample for the orders 1..N."""
    out = []
    for n in range(1, max_order + 1):
        left = _grams(hyp, n)
        best: dict[str, int] = {}
        for r in refs:
            for gram, cnt in _grams(r, n).items():
                if gram in left and cnt > best.get(gram, 0):
                    best[gram] = cnt
        out.append(sum(min(left[gram], cnt) for gram, cnt in best.items()))
    return out


def sample_stats(hyps: DataFrame, refs: DataFrame, id_col: str, hyp_col: str, ref_col: str, max_order: int = 4) -> DataFrame:
    """One row per sample: ``(id, matches ARRAY, possible ARRAY, hyp_len, ref_len)``, the arrays by order from 1.

    ``hyps``: one row per sample; ``refs``: one row per (sample, reference). The reference
    length is the shortest reference's. Samples without a hypothesis or without references give no rows.
    """
    def strings(col):
        return F.transform(F.col(col), lambda x: x.cast("string"))

    @F.arrow_udf("array<bigint>")
    def clipped(hyp: pa.Array, refs: pa.Array) -> pa.Array:
        return pa.array([_clipped(h.as_py(), r.as_py(), max_order) for h, r in zip(hyp, refs, strict=True)], pa.list_(pa.int64()))

    sides = hyps.select(id_col, strings(hyp_col).alias("hyp"), F.lit(None).cast("array<string>").alias("ref")).unionByName(
        refs.select(id_col, F.lit(None).cast("array<string>").alias("hyp"), strings(ref_col).alias("ref")))
    samples = sides.groupBy(id_col).agg(F.collect_list("hyp").alias("hyps"), F.collect_list("ref").alias("refs")).where(
        (F.size("hyps") > 0) & (F.size("refs") > 0)).select(id_col, F.get("hyps", F.lit(0)).alias("hyp"), "refs")
    orders = F.sequence(F.lit(1), F.lit(max_order))
    return samples.select(
        id_col, clipped("hyp", "refs").alias("matches"),
        F.transform(orders, lambda n: F.greatest(F.size("hyp") - n + 1, F.lit(0)).cast("long")).alias("possible"),
        F.size("hyp").alias("hyp_len"), F.array_min(F.transform("refs", F.size)).alias("ref_len"))


def bleu_stats(hyps: DataFrame, refs: DataFrame, id_col: str, hyp_col: str, ref_col: str,
               max_order: int = 4) -> DataFrame:
    """Per-sample sufficient statistics: ``(id, ord, matches, possible, hyp_len, ref_len)``, one row per sample and order."""
    samples = sample_stats(hyps, refs, id_col, hyp_col, ref_col, max_order)
    rows = samples.select("*", F.explode(F.sequence(F.lit(1), F.lit(max_order))).alias("ord"))
    return rows.select(id_col, "ord", F.element_at("matches", F.col("ord")).alias("matches"),
                       F.element_at("possible", F.col("ord")).alias("possible"), "hyp_len", "ref_len")


def _precision(matches: Column, possible: Column, smooth: bool) -> Column:
    if smooth:
        return (matches + 1.0) / (possible + 1.0)
    return F.when(possible > 0, matches / possible.cast("double")).otherwise(F.lit(0.0))


def _formula(df: DataFrame, keys: list[str], max_order: int) -> DataFrame:
    """BLEU (S7) of rows of ``(keys..., _ps, hyp_len, ref_len)``, ``_ps`` being the precisions by order."""
    logs = F.aggregate("_ps", F.lit(0.0), lambda a, p: a + F.when(p > 0, F.log(p)).otherwise(0.0))
    geo = F.when(F.array_min("_ps") > 0, F.exp(logs / max_order)).otherwise(F.lit(0.0))
    ratio = F.try_divide(F.col("hyp_len").cast("double"), F.col("ref_len").cast("double"))
    bp = F.when(ratio > 1.0, F.lit(1.0)).otherwise(F.exp(1.0 - F.try_divide(F.lit(1.0), ratio)))
    valid = (F.col("hyp_len") > 0) & (F.col("ref_len") > 0)
    return df.select(
        *keys,
        F.when(valid, geo * bp).alias("bleu"),
        F.col("_ps").alias("precisions"),
        F.when(valid, bp).alias("brevity_penalty"),
        ratio.alias("length_ratio"),
        "hyp_len",
        "ref_len",
    )


def bleu_from_stats(stats: DataFrame, keys: list[str], max_order: int = 4, smooth: bool = False) -> DataFrame:
    """BLEU and components from per-order statistics.

    ``stats`` holds ``(keys..., ord, matches, possible, hyp_len, ref_len)``; lengths are
    constant per key group. Empty candidate or reference gives NULL.
    """
    agg = stats.withColumn("_p", _precision(F.col("matches"), F.col("possible"), smooth)).groupBy(*keys).agg(
        F.first("hyp_len").alias("hyp_len"),
        F.first("ref_len").alias("ref_len"),
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "_p"))), lambda s: s["_p"]).alias("_ps"),
    )
    return _formula(agg, keys, max_order)


def sentence_bleu(hyps: DataFrame, refs: DataFrame, id_col: str, hyp_col: str, ref_col: str,
                  max_order: int = 4, smooth: bool = False) -> DataFrame:
    """One BLEU row per sample, from the sample's own arrays."""
    samples = sample_stats(hyps, refs, id_col, hyp_col, ref_col, max_order)
    precisions = F.transform(F.arrays_zip("matches", "possible"), lambda x: _precision(x["matches"], x["possible"], smooth))
    return _formula(samples.select(id_col, precisions.alias("_ps"), "hyp_len", "ref_len"), [id_col], max_order)


def corpus_bleu(hyps: DataFrame, refs: DataFrame, id_col: str, hyp_col: str, ref_col: str,
                max_order: int = 4, smooth: bool = False) -> DataFrame:
    """Matches, possible and lengths summed over all samples, then one formula."""
    stats = bleu_stats(hyps, refs, id_col, hyp_col, ref_col, max_order)
    # Every sample has exactly one row per order, so per-order sums of the lengths are the
    # corpus lengths: one aggregation, no join.
    per_order = stats.groupBy("ord").agg(
        F.sum("matches").alias("matches"),
        F.sum("possible").alias("possible"),
        F.sum("hyp_len").alias("hyp_len"),
        F.sum("ref_len").alias("ref_len"),
    )
    return bleu_from_stats(per_order.withColumn("_all", F.lit(1)), ["_all"], max_order, smooth).drop("_all")
