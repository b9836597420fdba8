"""Layered contribution graphs as edge tables, and path queries over them.

Nodes: ``X0_t`` (input token t), ``A{l}_t`` (after attention), ``M{l}_t`` (ffn block),
``I{l}_t`` (after ffn). Every edge goes to a strictly higher level
(X0 = 0, A_l = 3l+1, M_l = 3l+2, I_l = 3l+3), so reachability and best paths are level-by-
level joins over all graphs at once: one small job per level, no per-graph loop, no path
enumeration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

LEVEL_OFFSET = {"A": 1, "M": 2, "I": 3}


def node(kind: str, layer, token) -> Column:
    layer = F.lit(layer) if isinstance(layer, int) else layer
    return F.concat(F.lit(kind), layer.cast("string"), F.lit("_"), token.cast("string"))


def level(kind: str, layer) -> Column:
    layer = F.lit(layer) if isinstance(layer, int) else layer
    return layer * 3 + F.lit(LEVEL_OFFSET[kind])


def input_node(layer: Column, token: Column) -> Column:
    """``in(l, t)``: ``I{l-1}_t``, or ``X0_t`` for the first layer."""
    return F.when(layer == 0, F.concat(F.lit("X0_"), token.cast("string"))).otherwise(node("I", layer - 1, token))


def input_level(layer: Column) -> Column:
    return F.when(layer == 0, F.lit(0)).otherwise((layer - 1) * 3 + 3)


def graph_nodes(sizes: DataFrame) -> DataFrame:
    """``sizes(graph_id, n_layers, n_tokens)`` -> ``(graph_id, node, level)``; 3LT + T rows."""
    lt = sizes.select(
        "graph_id",
        F.explode(F.sequence(F.lit(0), F.col("n_layers") - 1)).alias("layer"),
        F.col("n_tokens"),
    ).select("graph_id", "layer", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 1)).alias("token"))
    blocks = lt.select(
        "graph_id",
        F.explode(F.array(*[F.struct(node(k, F.col("layer"), F.col("token")).alias("node"),
                                     level(k, F.col("layer")).alias("level")) for k in ("A", "M", "I")])).alias("n"),
    ).select("graph_id", "n.node", "n.level")
    inputs = sizes.select("graph_id", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 1)).alias("token")).select(
        "graph_id", F.concat(F.lit("X0_"), F.col("token").cast("string")).alias("node"), F.lit(0).alias("level")
    )
    return blocks.unionByName(inputs)


def sum_heads(attn: DataFrame) -> DataFrame:
    """Attention shares summed over heads: ``(graph_id, layer, to_tok, from_tok, share)``."""
    return attn.groupBy("graph_id", "layer", "to_tok", "from_tok").agg(F.sum("share").alias("share"))


def graph_edges(attn: DataFrame, resid_attn: DataFrame, ffn: DataFrame, resid_ffn: DataFrame,
                parallel: bool = False) -> DataFrame:
    """O90 + O91: edge table ``(graph_id, src, dst, src_level, dst_level, weight)``.

    ``attn``: per-head shares ``(graph_id, layer, to_tok, from_tok, head, share)``; the other
    three: ``(graph_id, layer, token, share)``. Repeated (src, dst) pairs (self-attention and
    the residual edge; in the parallel variant the residual also lands on A->I and in->I)
    are summed.
    """
    a = sum_heads(attn)
    L, T = F.col("layer"), F.col("token")
    parts = [
        a.select("graph_id", input_node(L, F.col("from_tok")).alias("src"), node("A", L, F.col("to_tok")).alias("dst"),
                 input_level(L).alias("src_level"), level("A", L).alias("dst_level"), F.col("share").alias("weight")),
        resid_attn.select("graph_id", input_node(L, T).alias("src"), node("A", L, T).alias("dst"),
                          input_level(L).alias("src_level"), level("A", L).alias("dst_level"),
                          F.col("share").alias("weight")),
    ]
    if not parallel:
        parts += [
            ffn.select("graph_id", node("A", L, T).alias("src"), node("M", L, T).alias("dst"),
                       level("A", L).alias("src_level"), level("M", L).alias("dst_level"),
                       F.col("share").alias("weight")),
            ffn.select("graph_id", node("M", L, T).alias("src"), node("I", L, T).alias("dst"),
                       level("M", L).alias("src_level"), level("I", L).alias("dst_level"),
                       F.col("share").alias("weight")),
            resid_ffn.select("graph_id", node("A", L, T).alias("src"), node("I", L, T).alias("dst"),
                             level("A", L).alias("src_level"), level("I", L).alias("dst_level"),
                             F.col("share").alias("weight")),
        ]
    else:
        parts += [
            resid_attn.select("graph_id", node("A", L, T).alias("src"), node("I", L, T).alias("dst"),
                              level("A", L).alias("src_level"), level("I", L).alias("dst_level"),
                              F.col("share").alias("weight")),
            ffn.select("graph_id", input_node(L, T).alias("src"), node("M", L, T).alias("dst"),
                       input_level(L).alias("src_level"), level("M", L).alias("dst_level"),
                       F.col("share").alias("weight")),
            ffn.select("graph_id", node("M", L, T).alias("src"), node("I", L, T).alias("dst"),
                       level("M", L).alias("src_level"), level("I", L).alias("dst_level"),
                       F.col("share").alias("weight")),
            resid_ffn.select("graph_id", input_node(L, T).alias("src"), node("I", L, T).alias("dst"),
                             input_level(L).alias("src_level"), level("I", L).alias("dst_level"),
                             F.col("share").alias("weight")),
        ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return merge_parallel_edges(edges)


def merge_parallel_edges(edges: DataFrame) -> DataFrame:
    """One edge per (graph, src, dst) with the summed weight."""
    return edges.groupBy("graph_id", "src", "dst", "src_level", "dst_level").agg(F.sum("weight").alias("weight"))


def edges_above(edges: DataFrame, threshold: float) -> DataFrame:
    """Strict ``weight > t``."""
    return edges.where(F.col("weight") > threshold)


class _ByLevel:
    """A table kept by level in the shared folder: a level is read alone, and rows are added for other levels.

    As every edge goes to a higher level, a level is complete when its turn comes, so each row is looked at once and
    the plan of a level does not hold those of the levels before.
    """

    def __init__(self, spark: SparkSession, name: str, first: DataFrame, by: str = "level"):
        self.spark, self.by, self.path = spark, by, scratch_path(spark, name)
        fields = [f for f in first.schema.fields if f.name != by]
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in [*fields, first.schema[by]]])
        self.add(first)

    def add(self, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("append").partitionBy(self.by).parquet(self.path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def at(self, level: int) -> DataFrame:
        return self.all().where(F.col(self.by) == level)


def _levels(edges: _ByLevel) -> list[int]:
    """The levels that edges hang on, ascending; at most three a layer."""
    return sorted(r[0] for r in edges.all().select(edges.by).distinct().collect())


def best_to_target(edges: DataFrame, targets: DataFrame, threshold: float = 0.0) -> DataFrame:
    """O96/O98 core: for every node, the heaviest path to its graph's target.

    ``targets(graph_id, node, level)``. Backward DP level by level (S21):
    ``best(v) = max over v->u of w + best(u)``; ties go to the lexicographically smallest
    path string. Returns ``(graph_id, node, score, path)`` with path = "v,...,target".
    Requires t >= 0 (then the heaviest path between two nodes uses only nodes between them).
    """
    if threshold < 0:
        raise ValueError("best path needs a non-negative threshold")
    spark = edges.sparkSession
    e = _ByLevel(spark, "path-edges", edges_above(edges, threshold).select("graph_id", "src", "dst", "src_level", "weight"), "src_level")
    best = _ByLevel(spark, "best-paths", targets.select("graph_id", "node", F.col("level").cast("int").alias("level"), F.lit(0.0).alias("score"), F.col("node").alias("path")))
    for lvl in reversed(_levels(e)):
        cand = e.at(lvl).join(best.all().select("graph_id", F.col("node").alias("dst"), "score", "path"), ["graph_id", "dst"])
        step = cand.groupBy("graph_id", F.col("src").alias("node")).agg(
            F.min(F.struct((-(F.col("weight") + F.col("score"))).alias("neg"),
                           F.concat_ws(",", F.col("src"), F.col("path")).alias("path"))).alias("b"))
        best.add(step.select("graph_id", "node", F.lit(lvl).alias("level"), (-F.col("b.neg")).alias("score"), F.col("b.path").alias("path")))
    return best.all().drop("level")


def reach(edges: DataFrame, starts: DataFrame, forward: bool = True, threshold: float = 0.0) -> DataFrame:
    """O95/O97 core: nodes reachable from (forward) or reaching (backward) each start.

    ``starts(graph_id, start, node, level)`` -> ``(graph_id, start, node)`` including the start.
    """
    here, there = ("src", "dst") if forward else ("dst", "src")
    kept = edges_above(edges, threshold).select(
        "graph_id", F.col(here).alias("node"), F.col(there).alias("next"), F.col(f"{there}_level").cast("int").alias("next_level"), F.col(f"{here}_level").cast("int").alias("level"))
    e = _ByLevel(edges.sparkSession, "reach-edges", kept)
    found = _ByLevel(edges.sparkSession, "reached", starts.select("graph_id", "start", "node", F.col("level").cast("int").alias("level")))
    levels = _levels(e)
    for lvl in levels if forward else reversed(levels):
        frontier = found.at(lvl).select("graph_id", "start", "node").distinct()  # found from several levels, looked at once
        step = frontier.join(e.at(lvl).drop("level"), ["graph_id", "node"]).select(
            "graph_id", "start", F.col("next").alias("node"), F.col("next_level").alias("level"))
        found.add(step.distinct())
    return found.all().select("graph_id", "start", "node").distinct()
