"""The registered queries of this subpackage: thin digests of the operators' own results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, filter_audit, learn, mih, ngram_join, pii, quality_rules, rule_ensemble, sharding, toxicity, url_reputation, warc, whitening
from .textops import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.figures(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "stats.n_words", "stats.word_chars", "stats.n_symbols", "stats.n_dup_lines", "stats.n_repeat_words",
        "base_failed", "kept", F.round("quality", 6).alias("quality"))


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(docs).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, want=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


@query("op7_url_filters", url_reputation.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return url_reputation.judged(pages, labels, url_reputation.RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleaved(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_warc")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = learn.held_out("doc_id", 5, 0)
    known = labels.where(~held_out & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("label"))
    model = toxicity.fit(docs.select("doc_id", "text"), known)
    out = toxicity.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op6_rule_ensemble")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = learn.held_out("doc_id", 4, 2)
    known = labels.where(~held_out & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("label"))
    model = rule_ensemble.fit(docs.select("doc_id", "text"), known)
    out = rule_ensemble.scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query("op10_ngram_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.joined(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "n_links")


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "first_word", "n_words", F.round("similarity", 6).alias("similarity"))


@query("op13_filter_audit", filter_audit.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whitened(table(spark, sf_dir, "embeddings"))
    # null where the exact value needs more than a long (from about 100 million rows on)
    return out.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained", "identity_error")


@query("op11_mih_neighbours")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mih.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
