"""Connected components of an undirected edge table, by large-star and small-star rounds.

Every round is joins and partial aggregates over the edges; a node with very many neighbours is
combined before the shuffle and its edges lie over many partitions. Each round is written to the shared
folder, so a lost executor costs at most one round. Rounds go on until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import written


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, v) with ``m``: the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v): the root is the least node of its component."""
    now = written(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        led = _least_neighbour(down)
        small = led.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(led.select("u", F.col("m").alias("v")))
        now = written(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
