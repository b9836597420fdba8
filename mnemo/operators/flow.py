"""Contribution graphs from part and whole vectors.

All vectors are rows ``(graph_id, layer, pos, vec)``, attention parts ``(graph_id, layer, pos, key_pos, head, vec)``. One job builds
the graphs of all samples and layers: shares are groups of (graph, layer, position), edges are projections of shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contributions import contributions, threshold_renormalize
from .graph import graph_edges

PLACE = ("graph_id", "layer", "pos")


def _parts(df: DataFrame, kind: str, key_pos=None, head=None) -> DataFrame:
    return df.select(
        F.struct(*PLACE).alias("group"), F.lit(kind).alias("kind"),
        (F.lit(None) if key_pos is None else F.col(key_pos)).cast("int").alias("key_pos"),
        (F.lit(None) if head is None else F.col(head)).cast("int").alias("head"), "vec")


def _shares(parts: list[DataFrame], wholes: DataFrame, p: int, threshold: float | None) -> DataFrame:
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    shares = contributions(every, wholes.select(F.struct(*PLACE).alias("group"), "vec"), "group", p=p).drop("vec")
    if threshold is not None:
        shares = threshold_renormalize(shares, threshold, "group")
    return shares.select(*[F.col(f"group.{c}").alias(c) for c in PLACE], "kind", "key_pos", "head", "share")


def attention_contributions(attn: DataFrame, resid_pre: DataFrame, resid_mid: DataFrame, p: int = 1, threshold: float | None = None) -> DataFrame:
    """The share of every (key position, head) and of the residual stream in what attention leaves."""
    return _shares([_parts(attn, "attn", "key_pos", "head"), _parts(resid_pre, "residual")], resid_mid, p, threshold)


def parallel_contributions(attn: DataFrame, mlp_out: DataFrame, resid_pre: DataFrame, resid_post: DataFrame, p: int = 1, threshold: float | None = None) -> DataFrame:
    """Shares of attention, feed-forward block and residual in one whole, with one denominator."""
    return _shares([_parts(attn, "attn", "key_pos", "head"), _parts(mlp_out, "mlp"), _parts(resid_pre, "residual")], resid_post, p, threshold)


def mlp_contributions(mlp_out: DataFrame, resid_mid: DataFrame, resid_post: DataFrame, p: int = 1, threshold: float | None = None) -> DataFrame:
    """The shares of the feed-forward block and of the residual stream."""
    return _shares([_parts(mlp_out, "mlp"), _parts(resid_mid, "residual")], resid_post, p, threshold)


def component_contributions(components: DataFrame, resid_mid: DataFrame, resid_post: DataFrame, p: int = 1) -> DataFrame:
    """One share for each hidden component ``(graph_id, layer, pos, component, vec)`` and the residual; ``head`` carries the component."""
    return _shares([_parts(components, "component", None, "component"), _parts(resid_mid, "residual")], resid_post, p, None)


def build_full_graph(attn: DataFrame, resid_pre: DataFrame, mlp_out: DataFrame, resid_post: DataFrame, resid_mid: DataFrame | None = None,
                     threshold: float | None = None, p: int = 1) -> DataFrame:
    """The merged edges ``(graph_id, src, dst, src_level, dst_level, weight)`` of all graphs.

    With ``resid_mid`` attention and feed-forward block follow each other and have denominators of their own; without it they
    run in parallel and share one. ``threshold`` drops shares up to it and rescales the rest (O87/O88). Positions whose whole
    vector is missing have no edges.
    """
    if resid_mid is None:
        first = second = parallel_contributions(attn, mlp_out, resid_pre, resid_post, p, threshold)
    else:
        first = attention_contributions(attn, resid_pre, resid_mid, p, threshold)
        second = mlp_contributions(mlp_out, resid_mid, resid_post, p, threshold)

    def one(shares: DataFrame, kind: str) -> DataFrame:
        return shares.where(F.col("kind") == kind).select("graph_id", "layer", F.col("pos").alias("token"), "share")

    heads = first.where("kind = 'attn'").select("graph_id", "layer", F.col("pos").alias("to_tok"), F.col("key_pos").alias("from_tok"), "head", "share")
    return graph_edges(heads, one(first, "residual"), one(second, "mlp"), one(second, "residual"), parallel=resid_mid is None)
