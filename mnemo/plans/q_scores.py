"""Stage 1 queries: corpus -> memorization scores and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import concat_sequences, detokenize
from ..operators.completion import attach_completions, model_parts, train_next_token
from ..operators.memorization import memorization_scores, prompt_table, score_summary, top_scores
from ..operators.relational import high_scores, low_scores, perfect_scores
from .catalog import register
from .sqlparts import model_ctes, scores_ctes, tokens_sql
from .tables import table

# Parameters shared by the score queries (reference defaults are 50/50; the corpus here is
# smaller, so 30/10 keeps most documents; k is the order of the stand-in model).
P, G, K = 30, 10, 3


#: Ids of labelled documents that every task may hold (some 64 bytes each); with more, texts are dealt by id.
HELD_IDS = 2_000_000


def training_docs(spark: SparkSession, sf: str, light: bool = False) -> DataFrame:
    """Documents the stand-in model is trained on: those labelled quality = 1. Texts stay where they lie while the ids are few enough to send."""
    labels = table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id")
    few = labels.count() <= HELD_IDS
    return table(spark, sf, "documents", light).join(F.broadcast(labels) if few else labels, "doc_id", "left_semi")


def training_parts(spark: SparkSession, sf: str, orders: int = 1) -> int:
    """Parts of a model of ``training_docs``; only the lengths of their texts are added up."""
    return model_parts(training_docs(spark, sf, light=True), orders)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", light=True)
    scores = memorization_scores(docs, training_docs(spark, sf), P, G, K, parts=training_parts(spark, sf))
    split = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("in_training"))
    return scores.join(split, "doc_id", "left").withColumn("in_training", F.coalesce("in_training", F.lit(False)))


@register(
    "scores_summary_by_split",
    "O26 O27 O29 O31 O53",
    f"""
WITH RECURSIVE {scores_ctes(P, G, K)}
SELECT in_training, count(*) AS n, round(avg(memorization_score), 6) AS mean_score,
       round(median(memorization_score), 6) AS median_score
FROM scores GROUP BY in_training
""",
)
def scores_summary_by_split(spark: SparkSession, sf: str) -> DataFrame:
    s = score_summary(scored(spark, sf), by=["in_training"])
    return s.select("in_training", "n", F.round("mean_score", 6).alias("mean_score"),
                    F.round("median_score", 6).alias("median_score"))


def _scores_sql(select: str) -> str:
    return f"WITH RECURSIVE {scores_ctes(P, G, K)} {select}"


@register(
    "scores_top10",
    "O60 O61",
    _scores_sql("SELECT doc_id, memorization_score FROM scores ORDER BY memorization_score DESC, doc_id LIMIT 10"),
)
def scores_top10(spark: SparkSession, sf: str) -> DataFrame:
    return top_scores(scored(spark, sf), 10, cols=()).select("doc_id", "memorization_score")


@register("scores_filter_high", "O16",
          _scores_sql("SELECT doc_id, memorization_score FROM scores WHERE memorization_score >= 0.75"))
def scores_filter_high(spark: SparkSession, sf: str) -> DataFrame:
    return high_scores(scored(spark, sf), 0.75).select("doc_id", "memorization_score")


@register("scores_filter_low", "O17", _scores_sql("SELECT doc_id FROM scores WHERE memorization_score <= 0.0"))
def scores_filter_low(spark: SparkSession, sf: str) -> DataFrame:
    return low_scores(scored(spark, sf), 0.0).select("doc_id")


@register("scores_perfect", "O18", _scores_sql("SELECT doc_id FROM scores WHERE memorization_score = 1.0"))
def scores_perfect(spark: SparkSession, sf: str) -> DataFrame:
    return perfect_scores(scored(spark, sf), "memorization_score").select("doc_id")


@register(
    "completions_joined",
    "O29 O30 O28",
    _scores_sql("SELECT doc_id, array_to_string(completion, ' ') AS decoded_completion, "
                "array_to_string(true_completion, ' ') AS decoded_true_completion FROM scores"),
)
def completions_joined(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    comp = s.select("doc_id", "decoded_completion")
    base = s.select("doc_id", "decoded_true_completion")
    return attach_completions(base, comp, "doc_id", "decoded_completion").select(
        "doc_id", "decoded_completion", "decoded_true_completion")


def _split_sql(p: int, g: int) -> str:
    return f"""WITH d AS (SELECT doc_id, coalesce({tokens_sql('text')}, []) AS toks FROM documents)
SELECT doc_id, array_to_string(list_slice(toks, 1, {p}), ' ') AS decoded_context,
       array_to_string(list_slice(toks, {p} + 1, {p} + {g}), ' ') AS decoded_true_completion,
       least(len(toks), {p} + {g}) AS whole_len, CASE WHEN len(toks) >= {p} + {g} THEN 'full' ELSE 'short' END AS status
FROM d"""


def _split(spark: SparkSession, sf: str, prompt_tokens: int, generation_tokens: int) -> DataFrame:
    p = prompt_table(table(spark, sf, "documents", light=True), prompt_tokens, generation_tokens)
    return p.select("doc_id", detokenize("context").alias("decoded_context"),
                    detokenize("true_completion").alias("decoded_true_completion"),
                    F.size(concat_sequences("context", "true_completion")).alias("whole_len"), "status")


@register("prompt_split", "O26 O27 O28 O32", _split_sql(P, G))
def prompt_split(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf, P, G)


@register("prompt_split_50_50", "O26 O27 O28 O32", _split_sql(50, 50))
def prompt_split_50_50(spark: SparkSession, sf: str) -> DataFrame:
    """The reference's 50/50."""
    return _split(spark, sf, 50, 50)


@register(
    "scores_50_50",
    "O26 O27 O29 O31",
    f"""WITH RECURSIVE {scores_ctes(50, 50, K)}
SELECT doc_id, status, round(memorization_score, 6) AS memorization_score, array_to_string(completion, ' ') AS decoded_completion FROM scores""",
)
def scores_50_50(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of every document at the reference's 50/50."""
    docs = table(spark, sf, "documents", light=True)
    s = memorization_scores(docs, training_docs(spark, sf), 50, 50, K, parts=training_parts(spark, sf))
    return s.select("doc_id", "status", F.round("memorization_score", 6).alias("memorization_score"), "decoded_completion")


@register(
    "ngram_model",
    "O29",
    f"""WITH {model_ctes(K)}
SELECT len(string_split(m.state, ' ')) AS ord, count(*) AS n_states, sum(g.cnt)::BIGINT AS total_next
FROM model m JOIN grams g ON g.state = m.state AND g.nxt = m.nxt GROUP BY ALL""",
)
def ngram_model(spark: SparkSession, sf: str) -> DataFrame:
    m = train_next_token(training_docs(spark, sf), K, parts=training_parts(spark, sf, K - 1))
    return m.groupBy(F.size(F.split("state", " ")).alias("ord")).agg(
        F.count(F.lit(1)).alias("n_states"), F.sum("cnt").alias("total_next"))
