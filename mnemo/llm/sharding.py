"""Sharding: proportional stratified interleaving.

Rows of each source are put in seeded-shuffled order; row r of the n of its source has the fractional
rank (r - 0.5) / n. Sorting all rows by fractional rank interleaves the sources in proportion, and
cutting that order into runs of equal length gives shards whose row counts differ by at most one and
whose mixture of sources matches the whole, to within one row a source.

Both orders are exact global ranks by range partitions (no single-task window): a source with a
third of all rows lies over many partitions. Only keys, sizes and checksums are moved, never texts.

Null texts have size 0 + 1 and checksum 0; a null source is a source of its own. Rows equal in all
keys (repeated rows) are interchangeable, so any order among them gives the same result. An empty table
gives an empty result. Columns of the input besides the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import global_rank
from .textops import written


def interleaved(docs: DataFrame, shards: int = 8, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17) -> DataFrame:
    """key, size, text_crc32, source, position (from 0, over all rows), shard and slot of every row."""
    rows = written(docs.select(
        F.col(key).alias(key), F.col(source).alias("source"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("_shuffle")), "shard-rows")
    order = [F.col("source").asc_nulls_first(), "_shuffle", F.col(key).asc_nulls_first(), "text_crc32", "size"]
    ranked = global_rank(rows, order, "_place")
    # One row a source; null sources get a name no source can have, for the join.
    named = ranked.withColumn("_source", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    sources = named.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_head"))
    placed = named.join(sources, "_source").withColumn("_rank", F.col("_place") - F.col("_head") + 1).withColumn(
        "_fraction", (F.col("_rank") - 0.5) / F.col("_n"))
    mixed = global_rank(placed.drop("_source", "_place", "_head"), ["_fraction", F.col("source").asc_nulls_first(), "_rank"], "_place")
    total = rows.count()
    per, more = divmod(total, shards)  # the first ``more`` shards have one row more
    at = F.col("_place") - 1
    edge = F.lit((per + 1) * more)
    shard = F.when(at < edge, F.floor(at / (per + 1))).otherwise(F.floor((at - edge) / max(per, 1)) + more)
    slot = F.when(at < edge, at % (per + 1)).otherwise((at - edge) % max(per, 1))
    return mixed.select(key, "source", "size", "text_crc32", at.alias("position"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
