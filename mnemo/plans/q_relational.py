"""Relational core queries: filters, take, dedup, ranks, shards, splits, vector normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import escape_control, snippet, tokenize
from ..operators.relational import (
    average_by_position,
    contiguous_shards,
    dedup_first,
    fixed_batches,
    min_max_normalize,
    rows_in,
    shuffle_head,
    sort_by,
    take,
    train_test_split,
)
from ..operators.tokens import decode, dictionary, encode
from .catalog import register
from .sqlparts import tokens_sql
from .tables import table


def _escape_sql(expr: str) -> str:
    out = f"replace(replace(replace({expr}, chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r')"
    for cp in range(32):
        if cp in (9, 10, 13):
            continue
        out = f"replace({out}, chr({cp}), '\\x{cp:02x}')"
    return out


@register("take_n", "O15", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 20")
def take_n(spark: SparkSession, sf: str) -> DataFrame:
    return take(table(spark, sf, "documents").select("doc_id", "n_chars"), 20, ["doc_id"])


@register(
    "rows_in_ids",
    "O19",
    "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def rows_in_ids(spark: SparkSession, sf: str) -> DataFrame:
    toxic = table(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id")
    return rows_in(table(spark, sf, "documents").select("doc_id", "lang"), toxic, "doc_id")


@register(
    "snippet",
    "O22",
    "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet "
    "FROM documents",
)
def snippet_q(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", snippet("text", 200).alias("snippet"))


@register(
    "escape_control",
    "O38",
    f"SELECT conv_id, turn, {_escape_sql('text')} AS escaped FROM conversations",
)
def escape_control_q(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", escape_control("text").alias("escaped"))


@register(
    "dedup_exact",
    "O55",
    "SELECT min(doc_id) AS doc_id, count(*) - 1 AS duplicates FROM documents GROUP BY text, lang, source",
)
def dedup_exact(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return dedup_first(docs, ["text", "lang", "source"], ["doc_id"]).select("doc_id", "duplicates")


@register(
    "dedup_pairs",
    "O56",
    """
WITH pairs AS (
  SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS reply
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
)
SELECT arg_min(conv_id, (conv_id, turn)) AS conv_id, arg_min(turn, (conv_id, turn)) AS turn, count(*) - 1 AS duplicates
FROM pairs GROUP BY prompt, reply
""",
)
def dedup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations")
    a = conv.select("conv_id", "turn", F.col("text").alias("prompt"))
    b = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    pairs = a.join(b, ["conv_id", "turn"])
    return dedup_first(pairs, ["prompt", "reply"], ["conv_id", "turn"]).select("conv_id", "turn", "duplicates")


@register(
    "contiguous_shards",
    "O62",
    """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS total FROM documents)
SELECT least((rn - 1) // (total // 7), 6)::INTEGER AS shard, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id
FROM r GROUP BY ALL
""",
)
def contiguous_shards_q(spark: SparkSession, sf: str) -> DataFrame:
    s = contiguous_shards(table(spark, sf, "documents").select("doc_id"), 7, ["doc_id"])
    return s.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"),
                                  F.max("doc_id").alias("last_id"))


@register(
    "fixed_batches",
    "O63",
    """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS rn FROM documents)
SELECT ((rn - 1) // 64)::INTEGER AS batch, count(*) AS n, min(doc_id) AS min_id, max(doc_id) AS max_id FROM r GROUP BY ALL
""",
)
def fixed_batches_q(spark: SparkSession, sf: str) -> DataFrame:
    b = fixed_batches(table(spark, sf, "documents").select("doc_id", "n_chars"), 64, ["n_chars", "doc_id"])
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("min_id"),
                                  F.max("doc_id").alias("max_id"))


@register(
    "train_test_split",
    "O64",
    """
WITH r AS (
  SELECT doc_id, row_number() OVER (ORDER BY (doc_id * 7919 + 42) % 1000003, doc_id) AS rn, count(*) OVER () AS total
  FROM documents
)
SELECT doc_id, CASE WHEN rn <= CAST(floor(0.1 * total) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM r
""",
)
def train_test_split_q(spark: SparkSession, sf: str) -> DataFrame:
    return train_test_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.1, 42)


@register(
    "shuffle_head",
    "O65",
    "SELECT doc_id, lang FROM documents ORDER BY (doc_id * 7919 + 7) % 1000003, doc_id LIMIT 25",
)
def shuffle_head_q(spark: SparkSession, sf: str) -> DataFrame:
    return shuffle_head(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 25, seed=7)


@register(
    "min_max_normalize",
    "O67",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
)
SELECT vec_id, (p - 1)::INTEGER AS pos,
       round((e[p] - list_min(e)) / nullif(list_max(e) - list_min(e), 0), 6) AS normalized
FROM (SELECT vec_id, e, unnest(generate_series(1, len(e))) AS p FROM v)
""",
)
def min_max_normalize_q(spark: SparkSession, sf: str) -> DataFrame:
    n = min_max_normalize(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    return n.select("vec_id", F.posexplode("normalized").alias("pos", "normalized")).select(
        "vec_id", "pos", F.round("normalized", 6).alias("normalized")
    )


_POSITIONS_SQL = """
WITH cells AS (
  SELECT (p - 1) AS pos, embedding[p]::DOUBLE AS value
  FROM (SELECT embedding, unnest(generate_series(1, len(embedding))) AS p FROM embeddings)
),
positions AS (SELECT range::INTEGER AS pos FROM range(0, 33))
SELECT p.pos, round(coalesce(avg(c.value), 0.0), 6) AS avg_value{more}
FROM positions p LEFT JOIN cells c ON c.pos = p.pos GROUP BY p.pos
"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("pos", "value")).select(
        "pos", F.col("value").cast("double").alias("value"))


@register("average_by_position", "O57", _POSITIONS_SQL.format(more=""))
def average_by_position_q(spark: SparkSession, sf: str) -> DataFrame:
    a = average_by_position(_cells(spark, sf), "pos", "value", 32)
    return a.select("pos", F.round("avg_value", 6).alias("avg_value"))


@register("average_by_position_all", "O57", _POSITIONS_SQL.format(more=", count(c.value) AS n_values"))
def average_by_position_all_q(spark: SparkSession, sf: str) -> DataFrame:
    """With the number of values behind each mean."""
    cells = _cells(spark, sf)
    a = average_by_position(cells, "pos", "value", 32)
    n = cells.groupBy("pos").agg(F.count("value").alias("n_values"))
    return a.join(n, "pos", "left").select("pos", F.round("avg_value", 6).alias("avg_value"),
                                           F.coalesce("n_values", F.lit(0)).alias("n_values"))


@register(
    "sorted_rows",
    "O61",
    "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, lang, doc_id) AS place FROM documents",
)
def sorted_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return sort_by(d, ["n_chars", "lang", "doc_id"], [False, True, True], "place").select("doc_id", "place")


@register(
    "ids_roundtrip",
    "O26 O28",
    f"""WITH d AS (SELECT doc_id, coalesce({tokens_sql('text')}, []) AS toks FROM documents),
vocab AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM d) GROUP BY token)
),
ids AS (SELECT x.doc_id, list(v.id ORDER BY x.i) AS ids FROM (SELECT doc_id, unnest(toks) AS token, unnest(generate_series(1, len(toks))) AS i FROM d) x JOIN vocab v ON v.token = x.token GROUP BY x.doc_id)
SELECT d.doc_id, len(d.toks)::INT AS n_ids, md5(coalesce(array_to_string(i.ids, ','), '')) AS ids_digest, md5(array_to_string(d.toks, ' ')) AS text_digest
FROM d LEFT JOIN ids i ON i.doc_id = d.doc_id""",
)
def ids_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as ids of a dictionary of all tokens, and back."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce(tokenize("text"), F.array().cast("array<string>")).alias("toks"))
    vocab = dictionary(d, "toks")
    ids = encode(d, "toks", vocab).select("doc_id", "ids")
    back = decode(ids, "ids", vocab, "tokens")
    said = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return back.select("doc_id", F.size("ids").alias("n_ids"), F.md5(said).alias("ids_digest"), F.md5(F.array_join("tokens", " ")).alias("text_digest"))
