"""BLEU queries over adjacent conversation turns (hypothesis = turn t+1, reference = turn t)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import tokenize
from ..operators.bleu import bleu_stats, clipped_matches, corpus_bleu, merge_reference_counts, ngram_counts, sentence_bleu
from .catalog import register
from .sqlparts import tokens_sql
from .tables import table

N = 4


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tokenize("text").alias("toks"))


def hyps_refs(spark: SparkSession, sf: str, multi: bool = False):
    """Hypothesis = turn t+1; references = turn t (and t+2 when ``multi``). Sample id = conv*1000+t+1."""
    t = _turns(spark, sf)
    hyps = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("toks").alias("hyp"))
    refs = t.select((F.col("conv_id") * 1000 + F.col("turn") + 1).alias("pair_id"), F.col("toks").alias("ref"))
    if multi:
        refs = refs.unionByName(
            t.select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("pair_id"), F.col("toks").alias("ref"))
        )
    # Only samples that have a hypothesis and at least one reference.
    hyps = hyps.join(refs.select("pair_id").distinct(), "pair_id", "left_semi")
    return hyps, refs


def _sql_ngrams(src: str, keys: str) -> str:
    return f"""
SELECT {keys}, n AS ord, array_to_string(list_slice(toks, i, i + n - 1), ' ') AS ngram, count(*) AS cnt
FROM (
  SELECT {keys}, toks, n, unnest(generate_series(1, len(toks) - n + 1)) AS i
  FROM (SELECT {keys}, toks, unnest(generate_series(1, {N})) AS n FROM {src})
  WHERE len(toks) >= n
) GROUP BY ALL"""


def _sql_stats(multi: bool) -> str:
    extra = (
        "UNION ALL SELECT conv_id * 1000 + turn - 1 AS pair_id, toks FROM t" if multi else ""
    )
    return f"""
t AS (SELECT conv_id, turn, {tokens_sql('text')} AS toks FROM conversations),
ref AS (
  SELECT row_number() OVER () AS ref_no, * FROM (
    SELECT conv_id * 1000 + turn + 1 AS pair_id, toks FROM t {extra}
  )
),
hyp AS (SELECT conv_id * 1000 + turn AS pair_id, toks FROM t WHERE conv_id * 1000 + turn IN (SELECT pair_id FROM ref)),
hc AS ({_sql_ngrams('hyp', 'pair_id')}),
rc AS (SELECT pair_id, ord, ngram, max(cnt) AS ref_cnt FROM ({_sql_ngrams('ref', 'pair_id, ref_no')}) GROUP BY ALL),
m AS (SELECT pair_id, ord, sum(least(cnt, ref_cnt)) AS matches FROM hc JOIN rc USING (pair_id, ord, ngram) GROUP BY ALL),
lens AS (
  SELECT h.pair_id, len(h.toks) AS hyp_len, r.ref_len
  FROM hyp h JOIN (SELECT pair_id, min(len(toks)) AS ref_len FROM ref GROUP BY pair_id) r USING (pair_id)
),
st AS (
  SELECT l.pair_id, o.ord, coalesce(m.matches, 0) AS matches, greatest(l.hyp_len - o.ord + 1, 0) AS possible,
         l.hyp_len, l.ref_len
  FROM lens l JOIN (SELECT unnest(generate_series(1, {N})) AS ord) o ON true
  LEFT JOIN m ON m.pair_id = l.pair_id AND m.ord = o.ord
)"""


def _sql_formula(keys: str, smooth: bool) -> str:
    prec = (
        "(matches + 1.0) / (possible + 1.0)"
        if smooth
        else "CASE WHEN possible > 0 THEN matches / possible::DOUBLE ELSE 0.0 END"
    )
    return f"""
pr AS (SELECT {keys}, ord, {prec} AS p, hyp_len, ref_len FROM st),
agg AS (
  SELECT {keys}, min(p) AS min_p, sum(CASE WHEN p > 0 THEN ln(p) END) AS log_sum,
         any_value(hyp_len) AS hyp_len, any_value(ref_len) AS ref_len,
         max(CASE WHEN ord = 1 THEN p END) AS p1, max(CASE WHEN ord = 2 THEN p END) AS p2,
         max(CASE WHEN ord = 3 THEN p END) AS p3, max(CASE WHEN ord = 4 THEN p END) AS p4
  FROM pr GROUP BY ALL
),
res AS (
  SELECT *, CASE WHEN min_p > 0 THEN exp(log_sum / {N}) ELSE 0.0 END AS geo,
         CASE WHEN ref_len = 0 THEN NULL ELSE hyp_len::DOUBLE / ref_len END AS ratio
  FROM agg
)"""


def _sql_select(keys: str) -> str:
    valid = "hyp_len > 0 AND ref_len > 0"
    bp = "CASE WHEN ratio > 1.0 THEN 1.0 ELSE exp(1.0 - 1.0 / ratio) END"
    return f"""
SELECT {keys}, round(CASE WHEN {valid} THEN geo * ({bp}) END, 6) AS bleu,
       round(CASE WHEN {valid} THEN {bp} END, 6) AS brevity_penalty, round(ratio, 6) AS length_ratio,
       round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4,
       hyp_len::BIGINT AS hyp_len, ref_len::BIGINT AS ref_len
FROM res"""


def _flat(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(
        *keys,
        F.round("bleu", 6).alias("bleu"),
        F.round("brevity_penalty", 6).alias("brevity_penalty"),
        F.round("length_ratio", 6).alias("length_ratio"),
        *[F.round(F.col("precisions")[i], 6).alias(f"p{i + 1}") for i in range(N)],
        F.col("hyp_len").cast("long").alias("hyp_len"),
        F.col("ref_len").cast("long").alias("ref_len"),
    )


@register(
    "ngram_counts",
    "O40",
    f"""
WITH t AS (SELECT conv_id, turn, {tokens_sql('text')} AS toks FROM conversations),
c AS ({_sql_ngrams('t', 'conv_id, turn')})
SELECT conv_id, ord, count(*) AS distinct_ngrams, sum(cnt)::BIGINT AS total, max(cnt) AS max_cnt
FROM c GROUP BY ALL
""",
)
def ngram_counts_q(spark: SparkSession, sf: str) -> DataFrame:
    c = ngram_counts(_turns(spark, sf), ["conv_id", "turn"], "toks", N)
    return c.groupBy("conv_id", "ord").agg(
        F.count(F.lit(1)).alias("distinct_ngrams"), F.sum("cnt").alias("total"), F.max("cnt").alias("max_cnt")
    )


@register(
    "clipped_matches",
    "O41 O42",
    f"WITH {_sql_stats(True)} SELECT pair_id, ord, matches::BIGINT AS matches FROM m",
)
def clipped_matches_q(spark: SparkSession, sf: str) -> DataFrame:
    hyps, refs = hyps_refs(spark, sf, multi=True)
    # Texts move once; their n-grams are counted where they are. The number is given, so parts are not merged by the size of the texts.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hyps, refs = hyps.repartition(parts, "pair_id"), refs.repartition(parts, "pair_id")
    hc = ngram_counts(hyps, ["pair_id"], "hyp", N)
    rc = ngram_counts(refs.withColumn("_ref", F.monotonically_increasing_id()), ["pair_id", "_ref"], "ref", N)
    m = clipped_matches(hc, merge_reference_counts(rc.drop("_ref"), "pair_id"), "pair_id")
    return m.select("pair_id", "ord", F.col("matches").cast("long").alias("matches"))


@register(
    "sentence_bleu",
    "O43 O45",
    f"WITH {_sql_stats(False)}, {_sql_formula('pair_id', False)} {_sql_select('pair_id')}",
)
def sentence_bleu_q(spark: SparkSession, sf: str) -> DataFrame:
    hyps, refs = hyps_refs(spark, sf)
    return _flat(sentence_bleu(hyps, refs, "pair_id", "hyp", "ref", N, smooth=False), ["pair_id"])


@register(
    "sentence_bleu_smooth",
    "O43 O45",
    f"WITH {_sql_stats(False)}, {_sql_formula('pair_id', True)} {_sql_select('pair_id')}",
)
def sentence_bleu_smooth_q(spark: SparkSession, sf: str) -> DataFrame:
    hyps, refs = hyps_refs(spark, sf)
    return _flat(sentence_bleu(hyps, refs, "pair_id", "hyp", "ref", N, smooth=True), ["pair_id"])


@register(
    "multi_reference_bleu",
    "O41 O43",
    f"WITH {_sql_stats(True)}, {_sql_formula('pair_id', True)} {_sql_select('pair_id')}",
)
def multi_reference_bleu_q(spark: SparkSession, sf: str) -> DataFrame:
    hyps, refs = hyps_refs(spark, sf, multi=True)
    return _flat(sentence_bleu(hyps, refs, "pair_id", "hyp", "ref", N, smooth=True), ["pair_id"])


@register(
    "corpus_bleu",
    "O44 O45",
    f"""
WITH {_sql_stats(False)},
st2 AS (SELECT ord, sum(matches) AS matches, sum(possible) AS possible, sum(hyp_len) AS hyp_len,
               sum(ref_len) AS ref_len, 1 AS one FROM st GROUP BY ord),
{_sql_formula('one', False).replace('FROM st', 'FROM st2')} {_sql_select('one')}
""".replace("SELECT one, round", "SELECT round"),
)
def corpus_bleu_q(spark: SparkSession, sf: str) -> DataFrame:
    hyps, refs = hyps_refs(spark, sf)
    return _flat(corpus_bleu(hyps, refs, "pair_id", "hyp", "ref", N, smooth=False), [])
