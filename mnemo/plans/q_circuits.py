"""Circuit-evaluation queries: logits from embeddings (64-way, clean = vector vec_id + 1),
evaluation pairs from conversations, edge scores from the events graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import tokenize
from ..operators.circuits import (
    first_answers,
    first_token_id,
    included_nodes,
    kl_to_clean,
    last_position,
    logit_diff,
    ranked_scores,
    score_threshold,
    smallest_prefix,
    swap_roles,
    top_n_edges,
)
from ..operators.relational import ratio
from ..operators.tokens import dictionary
from ..session import materialized, scratch_path
from ..sources.io import read_circuit_report, write_circuit_report
from .catalog import register
from .q_flow import _edges_sql, edges
from .sqlparts import tokens_sql
from .tables import table

TIES = ["graph_id", "src", "dst"]
TOP_N = 100


def _logits(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@register(
    "logit_diff",
    "O99 O100",
    "SELECT vec_id, round(embedding[label + 1]::DOUBLE - embedding[9 - label + 1]::DOUBLE, 6) AS logit_diff "
    "FROM embeddings",
)
def logit_diff_q(spark: SparkSession, sf: str) -> DataFrame:
    lg = _logits(spark, sf)
    return lg.select("vec_id", F.round(logit_diff(F.col("v"), F.col("label"), 9 - F.col("label")), 6).alias("logit_diff"))


@register(
    "mean_metric",
    "O58",
    "SELECT label, round(avg(embedding[label + 1]::DOUBLE - embedding[9 - label + 1]::DOUBLE), 6) AS mean_logit_diff "
    "FROM embeddings GROUP BY label",
)
def mean_metric_q(spark: SparkSession, sf: str) -> DataFrame:
    lg = _logits(spark, sf)
    return lg.groupBy("label").agg(
        F.round(F.avg(logit_diff(F.col("v"), F.col("label"), 9 - F.col("label"))), 6).alias("mean_logit_diff"))


@register(
    "kl_to_clean",
    "O101",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
j AS (SELECT a.vec_id, a.x, c.x AS c FROM v a JOIN v c ON c.vec_id = a.vec_id + 1),
l AS (
  SELECT *, list_max(x) + ln(list_sum(list_transform(x, lambda t: exp(t - list_max(x))))) AS lq,
         list_max(c) + ln(list_sum(list_transform(c, lambda t: exp(t - list_max(c))))) AS lp
  FROM j
)
SELECT vec_id, round(list_sum(list_transform(generate_series(1, len(x)),
         lambda i: exp(c[i] - lp) * ((c[i] - lp) - (x[i] - lq)))) / len(x), 6) AS kl
FROM l""",
)
def kl_to_clean_q(spark: SparkSession, sf: str) -> DataFrame:
    lg = _logits(spark, sf)
    clean = lg.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("c"))
    j = lg.join(clean, "vec_id")
    return j.select("vec_id", F.round(kl_to_clean(F.col("v"), F.col("c")), 6).alias("kl"))


def _eval_pairs(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.array("text").alias("answers"))
    alt = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("corrupt"))
    wrong = c.select("conv_id", (F.col("turn") - 3).alias("turn"), F.array("text").alias("wrong_answers"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("clean")).join(alt, ["conv_id", "turn"]).join(
        nxt, ["conv_id", "turn"], "left").join(wrong, ["conv_id", "turn"], "left")
    return pairs, c


EVAL_SQL = f"""
c AS (SELECT conv_id, turn, text, {tokens_sql('text')} AS toks FROM conversations),
vocab AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS id
  FROM (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM c) GROUP BY token)
),
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS clean, a.text AS corrupt, n.toks AS answers, w.toks AS wrong_answers
  FROM c u JOIN c a ON a.conv_id = u.conv_id AND a.turn = u.turn + 2
  LEFT JOIN c n ON n.conv_id = u.conv_id AND n.turn = u.turn + 1
  LEFT JOIN c w ON w.conv_id = u.conv_id AND w.turn = u.turn + 3
)"""


@register(
    "eval_pairs",
    "O20 O37",
    f"""WITH {EVAL_SQL}
SELECT p.conv_id, p.turn, coalesce(v1.id, -1) AS correct_token_id, coalesce(v2.id, -1) AS incorrect_token_id
FROM pairs p LEFT JOIN vocab v1 ON v1.token = p.answers[1] LEFT JOIN vocab v2 ON v2.token = p.wrong_answers[1]""",
)
def eval_pairs_q(spark: SparkSession, sf: str) -> DataFrame:
    pairs, turns = _eval_pairs(spark, sf)
    vocab = dictionary(turns.select(tokenize("text").alias("tokens")), "tokens").select("token", "id")
    out = first_token_id(F.col("correct_answer"), tokenize, vocab, "correct_token_id", first_answers(pairs))
    out = first_token_id(F.col("incorrect_answer"), tokenize, vocab, "incorrect_token_id", out)
    return out.select("conv_id", "turn", "correct_token_id", "incorrect_token_id")


@register(
    "mode_swap",
    "O21",
    f"""WITH {EVAL_SQL}
SELECT conv_id, turn, 'noising' AS mode, clean AS first, corrupt AS second FROM pairs
UNION ALL SELECT conv_id, turn, 'denoising', corrupt, clean FROM pairs""",
)
def mode_swap_q(spark: SparkSession, sf: str) -> DataFrame:
    pairs, _ = _eval_pairs(spark, sf)
    base = pairs.select("conv_id", "turn", "clean", "corrupt")
    n = swap_roles(base, "noising").withColumn("mode", F.lit("noising"))
    d = swap_roles(base, "denoising").withColumn("mode", F.lit("denoising"))
    return n.unionByName(d).select("conv_id", "turn", "mode", "first", "second")


def _seq_edges(spark, sf):
    return edges(spark, sf, False)[1].select("graph_id", "src", "dst", "weight")


@register(
    "top_n_edges",
    "O102",
    f"WITH {_edges_sql(False)} SELECT graph_id, src, dst, round(weight, 6) AS weight FROM edges "
    f"ORDER BY abs(weight) DESC, graph_id, src, dst LIMIT {TOP_N}",
)
def top_n_edges_q(spark: SparkSession, sf: str) -> DataFrame:
    t = top_n_edges(_seq_edges(spark, sf), TOP_N, "weight", TIES)
    return t.select("graph_id", "src", "dst", F.round("weight", 6).alias("weight"))


RANKED_SQL = (
    ", ranked AS (SELECT *, abs(weight) AS a, row_number() OVER (ORDER BY abs(weight) DESC, graph_id, src, dst) AS rank,"
    " sum(abs(weight)) OVER (ORDER BY abs(weight) DESC, graph_id, src, dst ROWS UNBOUNDED PRECEDING) AS cum FROM edges)"
)


@register(
    "score_threshold",
    "O103",
    f"WITH {_edges_sql(False)}{RANKED_SQL} SELECT round(a, 6) AS threshold FROM ranked WHERE rank = {TOP_N}",
)
def score_threshold_q(spark: SparkSession, sf: str) -> DataFrame:
    r = ranked_scores(_seq_edges(spark, sf), "weight", TIES)
    return score_threshold(r, TOP_N).select(F.round("threshold", 6).alias("threshold"))


@register(
    "smallest_prefix",
    "O104",
    f"""WITH {_edges_sql(False)}{RANKED_SQL}
SELECT min(rank) AS n, (SELECT count(*) FROM edges) AS total_edges, round((SELECT sum(abs(weight)) FROM edges), 6) AS total
FROM ranked WHERE cum >= 0.8 * (SELECT sum(abs(weight)) FROM edges)""",
)
def smallest_prefix_q(spark: SparkSession, sf: str) -> DataFrame:
    r = ranked_scores(_seq_edges(spark, sf), "weight", TIES)
    s = smallest_prefix(r, 0.8)
    return s.select(F.col("n").cast("long").alias("n"), F.col("total_edges").cast("long").alias("total_edges"),
                    F.round("total", 6).alias("total"))


@register(
    "included_nodes",
    "O105",
    f"""WITH {_edges_sql(False)},
top AS (SELECT * FROM edges ORDER BY abs(weight) DESC, graph_id, src, dst LIMIT {TOP_N})
SELECT count(*) AS n_nodes FROM (SELECT DISTINCT graph_id, unnest([src, dst]) AS node FROM top)""",
)
def included_nodes_q(spark: SparkSession, sf: str) -> DataFrame:
    t = top_n_edges(_seq_edges(spark, sf), TOP_N, "weight", TIES)
    return included_nodes(t, keys=["graph_id"])


@register(
    "ratio_report",
    "O59",
    f"""WITH {_edges_sql(False)},
top AS (SELECT * FROM edges ORDER BY abs(weight) DESC, graph_id, src, dst LIMIT {TOP_N})
SELECT (SELECT count(*) FROM top) AS kept_edges, count(*) AS total_edges,
       round((SELECT count(*) FROM top) / count(*)::DOUBLE, 6) AS edge_fraction,
       round((SELECT sum(abs(weight)) FROM top) / sum(abs(weight)), 6) AS metric_fraction
FROM edges""",
)
def ratio_report_q(spark: SparkSession, sf: str) -> DataFrame:
    return _ratios(_seq_edges(spark, sf))


def _ratios(e: DataFrame) -> DataFrame:
    e = materialized(e, "circuit-edges")
    kept = top_n_edges(e, TOP_N, "weight", TIES).agg(F.count(F.lit(1)).alias("kept_edges"), F.sum(F.abs("weight")).alias("kept_w"))
    total = e.agg(F.count(F.lit(1)).alias("total_edges"), F.sum(F.abs("weight")).alias("w"))
    return kept.crossJoin(total).select(  # one row each
        "kept_edges", "total_edges", F.round(ratio(F.col("kept_edges"), F.col("total_edges")), 6).alias("edge_fraction"),
        F.round(ratio(F.col("kept_w"), F.col("w")), 6).alias("metric_fraction"))


@register(
    "circuit_report",
    "O12 O59",
    f"""WITH {_edges_sql(False)},
top AS (SELECT * FROM edges ORDER BY abs(weight) DESC, graph_id, src, dst LIMIT {TOP_N})
SELECT {TOP_N} AS top_n, 'sequential' AS variant, (SELECT count(*) FROM top) AS kept_edges, count(*) AS total_edges,
       round((SELECT count(*) FROM top) / count(*)::DOUBLE, 6) AS edge_fraction,
       round((SELECT sum(abs(weight)) FROM top) / sum(abs(weight)), 6) AS metric_fraction
FROM edges""",
)
def circuit_report_q(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics and parameters written as a JSON object and read back."""
    path = scratch_path(spark, "report")
    report = _ratios(_seq_edges(spark, sf)).withColumns({"top_n": F.lit(TOP_N), "variant": F.lit("sequential")})
    write_circuit_report(report, path)
    return read_circuit_report(spark, path, report.schema)


@register(
    "last_position",
    "O99",
    """WITH l AS (SELECT vec_id // 4 AS sample, vec_id % 4 AS pos, embedding FROM embeddings)
SELECT sample, len(embedding) AS n, round(embedding[1]::DOUBLE, 6) AS first_logit, round(list_max(embedding)::DOUBLE, 6) AS largest
FROM l WHERE pos = 1 + sample % 3""",
)
def last_position_q(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences of four positions, of which the first 2 to 4 count: the logits at each one's last."""
    sample = F.floor(F.col("vec_id") / 4)
    lg = _logits(spark, sf).select(sample.alias("sample"), (F.col("vec_id") % 4).alias("pos"), "v", (2 + sample % 3).alias("length"))
    last = last_position(lg, "sample", "pos", "v", "length")
    return last.select("sample", F.size("v").cast("long").alias("n"), F.round(F.get("v", F.lit(0)), 6).alias("first_logit"), F.round(F.array_max("v"), 6).alias("largest"))
