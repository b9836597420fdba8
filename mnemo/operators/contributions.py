"""Share of each part vector in a whole vector.

Tables: parts ``(group, kind, part_id, vec ARRAY<DOUBLE>)`` and wholes ``(group, vec)``.
``d = max(|whole|_p - |part - whole + eps|_p, 1e-5)`` and share = d / sum of d in the group.
Group totals come from an aggregate joined back (map-side combined), never from a window
partitioned by the group, so a group holding a third of all parts is still spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIP = 1e-5


def _norm(v: Column, p: int) -> Column:
    if p == 1:
        return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return F.pow(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.pow(F.abs(x), p)), 1.0 / p)


def vector_sum(df: DataFrame, group_cols: list[str], vec_col: str, out_col: str = "vec") -> DataFrame:
    """Element-wise sum of vectors per group: exploded to (group, dim) and partially aggregated."""
    cells = df.select(*group_cols, F.posexplode(vec_col).alias("_d", "_x"))
    sums = cells.groupBy(*group_cols, "_d").agg(F.sum(F.col("_x").cast("double")).alias("_s"))
    return sums.groupBy(*group_cols).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_d", "_s"))), lambda s: s["_s"]).alias(out_col)
    )


def contributions(parts: DataFrame, wholes: DataFrame, group: str = "group", p: int = 1,
                  eps: float = 1e-6) -> DataFrame:
    """``parts`` + column ``share``; shares sum to 1 within each group."""
    w = wholes.select(F.col(group), F.col("vec").alias("_whole"))
    j = parts.join(w, group)
    diff = F.zip_with(F.col("vec"), F.col("_whole"), lambda a, b: a.cast("double") - b.cast("double") + F.lit(eps))
    whole64 = F.transform(F.col("_whole"), lambda x: x.cast("double"))
    d = F.greatest(_norm(whole64, p) - _norm(diff, p), F.lit(CLIP))
    with_d = j.withColumn("_d", d).drop("_whole")
    totals = with_d.groupBy(group).agg(F.sum("_d").alias("_total"))
    return with_d.join(totals, group).withColumn("share", F.col("_d") / F.col("_total")).drop("_d", "_total")


def with_one_off(parts: DataFrame, one_off: DataFrame, kind: str = "residual") -> DataFrame:
    """Add one extra part per group (residual, mlp, ...) before normalising together."""
    extra = one_off.select("group", F.lit(kind).alias("kind"), F.lit(-1).cast("long").alias("part_id"), "vec")
    return parts.select("group", "kind", "part_id", "vec").unionByName(extra)


def threshold_renormalize(shares: DataFrame, threshold: float, group: str = "group") -> DataFrame:
    """Shares <= t become 0; the rest are rescaled to sum to 1 per group.

    All kinds (blocks, mlp, residual) of a group share one denominator; a group whose shares
    are all dropped gets NULL (the reference divides by zero).
    """
    kept = shares.withColumn("_k", F.when(F.col("share") > threshold, F.col("share")).otherwise(F.lit(0.0)))
    totals = kept.groupBy(group).agg(F.sum("_k").alias("_den"))
    out = kept.join(totals, group).withColumn("share", F.try_divide(F.col("_k"), F.col("_den")))
    return out.drop("_k", "_den")
