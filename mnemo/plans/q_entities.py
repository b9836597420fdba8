"""Entity mapping queries: a gazetteer and triples derived from the benchmark texts, linked to all documents.

Surface forms are the benchmark's words and adjacent word pairs; a form's types are the lengths of its words,
its triples say which word follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import ngram_array, tokenize
from ..operators.entities import TYPE_RELATION, entity_mapping, link_entities, top_entities, triple_lookup
from ..session import bucketed
from .catalog import register
from .sqlparts import tokens_sql
from .tables import table

TOP = 5


def _forms(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, surface, n, next) of every word and word pair of the benchmark."""
    b = table(spark, sf, "benchmark").select("item_id", tokenize("text").alias("w"))

    def each(n: int):
        return F.transform(ngram_array("w", n), lambda g, i: F.struct(
            g.alias("surface"), F.lit(n).alias("n"), F.try_element_at(F.col("w"), (i + 1 + n).cast("int")).alias("next")))

    return b.select("item_id", F.inline(F.flatten(F.array(each(1), each(2)))))


def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    f = _forms(spark, sf)
    return f.groupBy("surface", "n").agg(F.countDistinct("item_id").alias("items")).select(
        "surface", F.concat(F.lit("res/"), "surface").alias("uri"),
        F.when(F.col("n") == 2, F.concat(F.lit("pair,"), F.length("surface").cast("string"))).otherwise("").alias("types"),
        F.try_divide(F.lit(1.0), F.col("items").cast("double")).alias("confidence"))


def triples(spark: SparkSession, sf: str) -> DataFrame:
    f = _forms(spark, sf)
    uri = F.concat(F.lit("res/"), "surface")
    lang = F.element_at(F.array(F.lit("de"), F.lit(""), F.lit("en")), (F.col("item_id") % 3 + 1).cast("int"))
    nexts = f.where("next is not null")
    return (nexts.select(uri.alias("resource"), F.lit("before").alias("relation"), F.concat(F.lit("res/"), "next").alias("target"),
                         F.lit(False).alias("is_literal"), F.lit(None).cast("string").alias("lang"))
            .unionByName(nexts.select(uri.alias("resource"), F.lit("label").alias("relation"), F.col("next").alias("target"),
                                      F.lit(True).alias("is_literal"), lang.alias("lang")))
            .unionByName(f.select(uri.alias("resource"), F.lit(TYPE_RELATION).alias("relation"), F.lit("form").alias("target"),
                                  F.lit(False).alias("is_literal"), F.lit(None).cast("string").alias("lang"))).distinct())


def _grams_sql(src: str, key: str, most: int) -> str:
    return f"""SELECT {key}, w, n, i AS pos, array_to_string(list_slice(w, i, i + n - 1), ' ') AS surface FROM (
  SELECT {key}, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
  FROM (SELECT {key}, {tokens_sql('text')} AS w, unnest(generate_series(1, {most})) AS n FROM {src}) WHERE len(w) >= n)"""


MENTIONS_SQL = f"""
forms AS (SELECT item_id, surface, n, w[pos + n] AS next FROM ({_grams_sql('benchmark', 'item_id', 2)})),
gaz AS (SELECT surface, 'res/' || surface AS uri, CASE WHEN n = 2 THEN 'pair,' || length(surface) ELSE '' END AS types,
        1.0::DOUBLE / count(DISTINCT item_id) AS confidence FROM forms GROUP BY surface, n),
longest AS (
  SELECT g.doc_id, g.pos, g.n, z.* FROM ({_grams_sql('documents', 'doc_id', 2)}) g JOIN gaz z USING (surface)
  QUALIFY row_number() OVER (PARTITION BY g.doc_id, g.pos ORDER BY g.n DESC) = 1
),
mentions AS MATERIALIZED (
  SELECT * FROM longest
  QUALIFY coalesce(max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < pos + n, true)
)"""

TRIPLES_SQL = f"""
triples AS (
  SELECT 'res/' || surface AS resource, 'before' AS relation, 'res/' || next AS target, false AS is_literal, NULL AS lang FROM forms WHERE next IS NOT NULL
  UNION SELECT 'res/' || surface, 'label', next, true, ['de', '', 'en'][item_id % 3 + 1] FROM forms WHERE next IS NOT NULL
  UNION SELECT 'res/' || surface, '{TYPE_RELATION}', 'form', false, NULL FROM forms
),
found AS (
  SELECT DISTINCT resource AS uri, relation, target FROM triples
  WHERE relation <> '{TYPE_RELATION}' AND (NOT is_literal OR lang IN ('', 'en')) AND resource IN (SELECT uri FROM mentions)
)"""


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    return link_entities(table(spark, sf, "documents"), gazetteer(spark, sf), 2)


@register("entity_mentions", "O77 O78", f"""WITH {MENTIONS_SQL}
SELECT doc_id, pos, surface, uri, string_split(types, ',')[1] AS first_type, len(string_split(types, ',')) AS n_types, round(confidence, 6) AS confidence
FROM mentions""")
def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return _mentions(spark, sf).select("doc_id", "pos", "surface", "uri", F.element_at("types", 1).alias("first_type"),
                                       F.size("types").alias("n_types"), F.round("confidence", 6).alias("confidence"))


@register("top_entities", "O66", f"""WITH {MENTIONS_SQL}
SELECT doc_id, pos, surface, uri FROM mentions QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= {TOP}""")
def top_entities_q(spark: SparkSession, sf: str) -> DataFrame:
    return top_entities(_mentions(spark, sf), TOP).select("doc_id", "pos", "surface", "uri")


@register("triples_for_entities", "O51 O52", f"WITH {MENTIONS_SQL}, {TRIPLES_SQL} SELECT uri, relation, target FROM found")
def triples_for_entities(spark: SparkSession, sf: str) -> DataFrame:
    return triple_lookup(_mentions(spark, sf), triples(spark, sf))


@register("entity_mapping", "O22 O79 O80", f"""WITH {MENTIONS_SQL}, {TRIPLES_SQL},
per_uri AS (SELECT uri, count(*) AS n FROM found GROUP BY uri),
ents AS (SELECT doc_id, count(*) AS n_entities, string_agg(surface, '|' ORDER BY pos) AS entity_texts FROM mentions GROUP BY doc_id),
maps AS (SELECT doc_id, string_agg(surface, '|' ORDER BY surface) AS mapped, sum(n)::BIGINT AS n_relations
         FROM (SELECT DISTINCT doc_id, surface, uri FROM mentions) JOIN per_uri USING (uri) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' WHEN length(text) > 0 THEN text END AS text_snippet,
       coalesce(n_entities, 0)::INT AS n_entities, coalesce(entity_texts, '') AS entity_texts, coalesce(mapped, '') AS mapped,
       coalesce(n_relations, 0) AS n_relations
FROM documents d LEFT JOIN ents USING (doc_id) LEFT JOIN maps USING (doc_id)""")
def entity_mapping_q(spark: SparkSession, sf: str) -> DataFrame:
    m = bucketed(_mentions(spark, sf), "doc_id", "mentions")  # found once, used three times; by text already
    out = entity_mapping(table(spark, sf, "documents"), m, triple_lookup(m, triples(spark, sf)))
    return out.select("doc_id", "text_snippet", F.size("entities").alias("n_entities"),
                      F.array_join(F.transform("entities", lambda e: e["text"]), "|").alias("entity_texts"),
                      F.array_join(F.array_sort(F.map_keys("relations")), "|").alias("mapped"),
                      F.aggregate(F.map_values("relations"), F.lit(0).cast("long"), lambda a, v: a + F.size(v["relations"])).alias("n_relations"))
