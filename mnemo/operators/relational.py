"""Filters, dedup, ranks, shards, splits and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


# --- predicates (O16-O19) -------------------------------------------------------------

def high_scores(df: DataFrame, threshold: float, col: str = "memorization_score") -> DataFrame:
    """Score >= t (pushed to the parquet scan when the input is a file)."""
    return df.where(F.col(col) >= F.lit(threshold))


def low_scores(df: DataFrame, threshold: float = 0.0, col: str = "memorization_score") -> DataFrame:
    """Score <= t."""
    return df.where(F.col(col) <= F.lit(threshold))


def perfect_scores(df: DataFrame, col: str = "acc") -> DataFrame:
    """score == 1."""
    return df.where(F.col(col) == F.lit(1.0))


def rows_in(df: DataFrame, ids: DataFrame | list, key: str) -> DataFrame:
    """Keep rows whose key is in ``ids`` (a literal list or a DataFrame of keys).

    A DataFrame of keys becomes a left-semi join; the planner broadcasts it only when its
    measured size is under the broadcast threshold.
    """
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    return df.where(F.col(key).isin(list(ids)))


def take(df: DataFrame, n: int, order) -> DataFrame:
    """First n rows by a deterministic order (TakeOrderedAndProject)."""
    return df.orderBy(*_cols(order)).limit(n)


# --- dedup (O55, O56) ------------------------------------------------------------------

def dedup_first(df: DataFrame, keys: list[str], order_cols) -> DataFrame:
    """Keep the first row (smallest ``order_cols``) of every key; adds ``duplicates``.

    An aggregate rather than a window: ``min(struct(order..., row...))`` is combined
    map-side, so a key holding a third of all rows never lands whole in one task.
    """
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    others = [c for c in df.columns if c not in keys and c not in order_cols]
    first = F.min(F.struct(*[F.col(c) for c in order_cols + others])).alias("_first")
    agg = df.groupBy(*keys).agg(first, (F.count(F.lit(1)) - 1).alias("duplicates"))
    return agg.select(*keys, "_first.*", "duplicates")


# --- exact global rank (S10) -----------------------------------------------------------

def global_rank(df: DataFrame, order, rank_col: str = "rank", partitions: int | None = None) -> DataFrame:
    """Exact 1-based row number over a total order without moving all rows to one task.

    Range-partition on the order, number rows inside each partition, then add the running
    row count of all earlier partitions (one small row per partition, broadcast). The order
    must be total (end it with a unique key). The partitioned table is checkpointed once so
    the counting pass and the numbering pass see the same partition contents.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    oc = _cols(order)
    ranged = df.repartitionByRange(n, *oc).sortWithinPartitions(*oc)
    ranged = ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    # One row per partition: a window without partitioning is bounded here.
    offsets = counts.withColumn(
        "_off", F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    )
    out = ranged.join(F.broadcast(offsets.select("_pid", "_off", "_first")), "_pid")
    return out.withColumn(rank_col, F.col("_off") + (F.col("_mono") - F.col("_first")) + 1).drop(
        "_pid", "_mono", "_off", "_first"
    )


def sort_by(df: DataFrame, cols: list[str], ascending: list[bool] | None = None, place: str | None = None) -> DataFrame:
    """Rows by the columns, nulls first where ascending and last where descending; end them with a unique one.

    With ``place`` the 1-based place is added, which outlasts later shuffles.
    """
    up = ascending or [True] * len(cols)
    order = [F.col(c).asc_nulls_first() if a else F.col(c).desc_nulls_last() for c, a in zip(cols, up)]
    return global_rank(df, order, place) if place else df.orderBy(*order)


def contiguous_shards(df: DataFrame, n_shards: int, order, shard_col: str = "shard") -> DataFrame:
    """floor(rows/n) consecutive rows per shard, the last shard takes the remainder."""
    ranked = global_rank(df, order, "_r")
    total = ranked.agg(F.count(F.lit(1))).first()[0]
    size = total // n_shards
    shard = F.lit(n_shards - 1) if size == 0 else F.least(F.floor((F.col("_r") - 1) / size), F.lit(n_shards - 1))
    return ranked.withColumn(shard_col, shard.cast("int")).drop("_r")


def fixed_batches(df: DataFrame, batch_size: int, order, batch_col: str = "batch") -> DataFrame:
    """Consecutive rows in groups of ``batch_size`` (last group short)."""
    ranked = global_rank(df, order, "_r")
    return ranked.withColumn(batch_col, F.floor((F.col("_r") - 1) / batch_size).cast("int")).drop("_r")


def split_key(id_col: str, seed: int) -> Column:
    """Seeded arithmetic hash used to order rows for splits and shuffles (repeatable in SQL)."""
    return F.pmod(F.col(id_col) * F.lit(7919) + F.lit(seed), F.lit(1000003))


def train_test_split(df: DataFrame, id_col: str, test_size: float = 0.1, seed: int = 42,
                     split_col: str = "split") -> DataFrame:
    """Exactly int(test_size * n) test rows, chosen by the seeded hash order."""
    ranked = global_rank(df, [split_key(id_col, seed), F.col(id_col)], "_r")
    total = ranked.agg(F.count(F.lit(1))).first()[0]
    n_test = int(test_size * total)
    return ranked.withColumn(split_col, F.when(F.col("_r") <= n_test, "test").otherwise("train")).drop("_r")


def shuffle_head(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Seeded random order, first n rows."""
    return df.orderBy(split_key(id_col, seed), F.col(id_col)).limit(n)


# --- aggregates (O53, O54, O57-O59, O67) -------------------------------------------------

def min_max_normalize(df: DataFrame, values_col: str, out_col: str = "normalized") -> DataFrame:
    """Per-row scaling of a vector to [0, 1] (array expressions, no shuffle)."""
    v = F.transform(F.col(values_col), lambda x: x.cast("double"))
    lo, hi = F.array_min(v), F.array_max(v)
    return df.withColumn(out_col, F.transform(v, lambda x: F.try_divide(x - lo, hi - lo)))


def average_by_position(df: DataFrame, pos_col: str, value_col: str, max_pos: int = 32) -> DataFrame:
    """Mean value per position 0..max_pos; positions without data give 0."""
    spark = df.sparkSession
    positions = spark.range(0, max_pos + 1).select(F.col("id").cast("int").alias(pos_col))
    means = df.where(F.col(pos_col) <= max_pos).groupBy(pos_col).agg(F.avg(value_col).alias("avg_value"))
    return positions.join(means, pos_col, "left").select(pos_col, F.coalesce("avg_value", F.lit(0.0)).alias("avg_value"))


def ratio(num: Column, den: Column) -> Column:
    """NULL instead of a division error on an empty denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def global_cumsum(df: DataFrame, order, value: str, rank_col: str = "rank", cum_col: str = "cum",
                  partitions: int | None = None) -> DataFrame:
    """Exact running sum (and row number) over a total order, partition-parallel.

    Same scheme as ``global_rank``: range partitions, a running sum inside each partition
    (a window over one range partition, bounded by the partition size) plus the totals of all
    earlier partitions (one row per partition, broadcast).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    oc = _cols(order)
    ranged = df.repartitionByRange(n, *oc).withColumn("_pid", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    w = Window.partitionBy("_pid").orderBy(*oc).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_lr", F.row_number().over(Window.partitionBy("_pid").orderBy(*oc))).withColumn(
        "_lc", F.sum(value).over(w))
    totals = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    prior = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_on"),
                            F.coalesce(F.sum("_s").over(prior), F.lit(0.0)).alias("_os"))
    out = local.join(F.broadcast(offsets), "_pid")
    return out.withColumn(rank_col, F.col("_on") + F.col("_lr")).withColumn(cum_col, F.col("_os") + F.col("_lc")).drop(
        "_pid", "_lr", "_lc", "_on", "_os")
