"""Corpus -> memorization scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import completion_part, context_part, detokenize, first_tokens, memorization_score
from ..session import materialized
from .completion import greedy_complete, model_parts, stored_model, train_next_token
from .relational import global_cumsum


def prompt_table(docs: DataFrame, prompt_tokens: int, generation_tokens: int, id_col: str = "doc_id",
                 text_col: str = "text", keep=()) -> DataFrame:
    """O26 + O27 of every row: ``context`` and ``true_completion`` as far as the text goes.

    ``status`` is 'short' for rows of fewer than P+G tokens (null and empty texts have none), else 'full'.
    """
    toks = docs.select(id_col, *keep, F.coalesce(first_tokens(text_col, prompt_tokens + generation_tokens), F.array().cast("array<string>")).alias("tokens"))
    return toks.select(
        id_col,
        *keep,
        context_part("tokens", prompt_tokens).alias("context"),
        completion_part("tokens", prompt_tokens, generation_tokens).alias("true_completion"),
        F.when(F.size("tokens") >= prompt_tokens + generation_tokens, "full").otherwise("short").alias("status"),
    )


#: The earlier name of what ``prompt_table`` does now: every row stays.
prompt_table_all = prompt_table


def score_prompts(prompts: DataFrame, model: DataFrame, k: int, generation_tokens: int, stored: bool = False,
                  texts: DataFrame | None = None) -> DataFrame:
    """O29 + O31: greedy completion of each context, scored against the true completion.

    Every row is continued by G tokens and its matches are divided by G: what a short text lacks counts as
    padding, which no continuation matches. ``stored``: the model is one of ``stored_model``; ``texts``: as in ``greedy_walk``.
    """
    done = greedy_complete(prompts, model, k, "context", generation_tokens, stored, texts)
    return done.withColumnRenamed("generated", "completion").withColumn(
        "memorization_score", memorization_score("completion", "true_completion", generation_tokens)
    )


def scored_prompts(docs: DataFrame, model: DataFrame, prompt_tokens: int = 30, generation_tokens: int = 10, k: int = 3,
                   keep=(), stored: bool = False, texts: DataFrame | None = None) -> DataFrame:
    """D3 records by a model trained before (decoded columns are the space-joined tokens). ``docs`` are read once: their prompts are written."""
    prompts = materialized(prompt_table(docs, prompt_tokens, generation_tokens, keep=keep), "prompts")
    return _records(score_prompts(prompts, model, k, generation_tokens, stored, texts), keep)


def _records(scored: DataFrame, keep) -> DataFrame:
    return scored.select(
        "doc_id",
        *keep,
        "context",
        detokenize("context").alias("decoded_context"),
        "completion",
        detokenize("completion").alias("decoded_completion"),
        "true_completion",
        detokenize("true_completion").alias("decoded_true_completion"),
        "memorization_score",
        "status",
    )


def memorization_scores(docs: DataFrame, training_docs: DataFrame, prompt_tokens: int = 30,
                        generation_tokens: int = 10, k: int = 3, keep=(), parts: int | None = None) -> DataFrame:
    """Whole stage 1: a model of ``training_docs`` and the D3 records of ``docs``.

    Contexts shorter than k are learned only as far as some document has one. ``docs`` are read once: their prompts are written.
    ``parts``: the ``model_parts`` of ``training_docs``, if known.
    """
    prompts = materialized(prompt_table(docs, prompt_tokens, generation_tokens, keep=keep), "prompts")
    contexts = prompts.where((F.size("context") > 0) & (F.size("context") < k))
    heads = materialized(contexts.select(F.get("context", F.lit(0)).alias("token")).distinct(), "short-prompts")
    parts = parts or model_parts(training_docs, max(k - 1, 1) if prompt_tokens < k else 1)
    model = stored_model(train_next_token(training_docs, k, min_order=k, heads=None if heads.isEmpty() else heads, parts=parts), parts)
    return _records(score_prompts(prompts, model, k, generation_tokens, stored=True), keep)


def score_summary(scores: DataFrame, by=(), score_col: str = "memorization_score") -> DataFrame:
    """Count, mean and exact median of the score (optionally per group; null scores count only as rows).

    The median is found from counts of values and their running sum in the order of (group, value), which lies over range
    partitions: a group is never gathered, whatever its number of rows or values.
    """
    counts = scores.groupBy(*by, score_col).agg(F.count(F.lit(1)).alias("_n"))
    order = [F.col(c).asc_nulls_first() for c in (*by, score_col)]
    ranked = global_cumsum(counts, order, "_n", "_rank", "_upto")
    known = F.col(score_col).isNotNull()
    # Null scores come first in a group, so values start after them.
    groups = ranked.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.sum(F.when(known, F.col("_n"))).alias("_known"),
        (F.sum(F.when(known, F.col("_n") * F.col(score_col))) / F.sum(F.when(known, F.col("_n")))).alias("mean_score"),
        F.min(F.when(known, F.col("_upto") - F.col("_n"))).alias("_before"))
    keys = [f"_by{k}" for k in range(len(by))]
    named = groups.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], "_known", "_before")
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)]
    rows = ranked.where(known).join(named, same) if by else ranked.where(known).crossJoin(named)  # one row of totals
    low, high = F.col("_before") + F.floor((F.col("_known") + 1) / 2), F.col("_before") + F.floor((F.col("_known") + 2) / 2)

    def at(place):
        return F.max(F.when((F.col("_upto") - F.col("_n") < place) & (place <= F.col("_upto")), F.col(score_col)))

    medians = rows.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median_score"))
    back = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)]
    out = groups.join(medians, back, "left") if by else groups.crossJoin(medians)
    return out.select(*by, "n", "mean_score", "median_score")


def top_scores(scores: DataFrame, n: int = 10, score_col: str = "memorization_score", id_col: str = "doc_id",
               cols=("decoded_context", "decoded_completion")) -> DataFrame:
    """N highest scores (ties by id); planned as TakeOrderedAndProject."""
    return scores.orderBy(F.col(score_col).desc(), F.col(id_col)).limit(n).select(id_col, score_col, *cols)
