"""Corpus pipeline: documents through the stages of ``STAGES``, each written as Parquet and reread.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``, works on every row that the one before kept, and
returns the columns of ``documents``; the last adds the tokens' columns.

Null texts fail the quality rules. Extra columns of ``docs`` go along. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.llm import bpe, decontaminate, ngram_join, pii, quality_rules
from mnemo.llm.textops import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or that the weighted rules judge bad, go."""
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 over five-word shingles the one with the least id stays."""
    return ngram_join.one_of_each(docs, n=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; ``n_chars`` follows the text."""
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, their number, and whether decoding gives the text back."""
    out = bpe.encode(docs, want=("ids", "n_tokens", "decoded"))
    return out.withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit(""))).drop("decoded")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("PII", personal_data),
    ("BPE encoding and decoding", tokens),
]

#: Expectation-maximisation, connected components, SimHash and BPE: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
