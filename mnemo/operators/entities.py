"""Entity mapping (O51, O52, O66, O77-O80): mentions by gazetteer, triples by join, one mapping per text.

The annotation service and the triple store are tables here: a gazetteer ``(surface, uri, types,
confidence)`` and triples ``(resource, relation, target, is_literal, lang)``. Neither join carries a
hint: the planner broadcasts a side it measures as small, and a surface form that very many texts
contain is split by the skew join otherwise. Lookups run once per distinct uri.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import ngram_array, snippet, tokenize
from ..session import materialized

# Fixed value: the relation that is never returned.
TYPE_RELATION = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def best_entries(gazetteer: DataFrame) -> DataFrame:
    """One entry per surface form: the most confident, then the least uri."""
    best = F.min(F.struct((-F.col("confidence")).alias("_c"), "uri", "types")).alias("_b")
    return gazetteer.where(F.col("surface").isNotNull()).groupBy("surface").agg(best).select(
        "surface", "_b.uri", F.split("_b.types", ",").alias("types"), (-F.col("_b._c")).alias("confidence"))


def link_entities(docs: DataFrame, gazetteer: DataFrame, max_words: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, pos, n_words, surface, uri, types, confidence)``, ``pos`` counting words from 1.

    At each word the longest surface form that starts there is taken; one that lies inside another
    is dropped. Null and empty texts have no mentions. The type list is split at commas (an empty
    list gives one empty string).
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Texts move once, by id; spans are looked up, and the longest ones found, where they are.
    words = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).repartition(parts, "_id").select("_id", tokenize("_t").alias("_w"))
    # Written, so that the planner knows its size and sends it to the spans if small, not the spans to it.
    entries = materialized(best_entries(gazetteer), "gazetteer")

    def grams(n: int):
        return F.transform(ngram_array("_w", n), lambda g, i: F.struct((i + 1).alias("pos"), F.lit(n).alias("n_words"), g.alias("surface")))

    spans = words.select("_id", F.inline(F.flatten(F.array(*[grams(n) for n in range(1, max_words + 1)]))))
    found = spans.join(entries.select("surface"), "surface", "left_semi")
    # One text's mentions: the running end of all earlier starts.
    longest = found.groupBy("_id", "pos").agg(F.max(F.struct("n_words", "surface")).alias("_m")).select("_id", "pos", "_m.*")
    before = Window.partitionBy("_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    reach = longest.withColumn("_end", F.max(F.col("pos") + F.col("n_words")).over(before))
    kept = reach.where(F.col("_end").isNull() | (F.col("_end") < F.col("pos") + F.col("n_words"))).drop("_end")
    return kept.join(entries, "surface").select(F.col("_id").alias(id_col), "pos", "n_words", "surface", "uri", "types", "confidence")


def top_entities(mentions: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """The first ``n`` mentions per text in source order (a row-number filter, cut before the shuffle too)."""
    first = Window.partitionBy(id_col).orderBy("pos")
    return mentions.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= n).drop("_k")


def triple_lookup(uris: DataFrame, triples: DataFrame, limit: int | None = None) -> DataFrame:
    """``(uri, relation, target)`` of each distinct uri.

    Type relations and literals in languages other than English go. ``limit`` keeps that many per
    uri (least relation and target first); by default all.
    """
    wanted = uris.select("uri").where(F.col("uri").isNotNull()).distinct()
    usable = triples.where((F.col("relation") != TYPE_RELATION) & (
        ~F.col("is_literal") | F.coalesce("lang", F.lit("")).isin("", "en"))).select(F.col("resource").alias("uri"), "relation", "target").distinct()
    found = usable.join(wanted, "uri", "left_semi")
    if limit is None:
        return found
    order = Window.partitionBy("uri").orderBy("relation", "target")
    return found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= limit).drop("_k")


def entity_mapping(docs: DataFrame, mentions: DataFrame, relations: DataFrame, id_col: str = "doc_id", text: str = "text",
                   max_entities: int | None = None) -> DataFrame:
    """``(id, text_snippet, entities, relations)`` of every text.

    ``entities``: all mentions in source order. ``relations``: map of surface form to its uri, types
    and relations, for those with any; of repeated surface forms the last wins. Only the first
    ``max_entities`` mentions are looked up if given. Texts without words: empty, and no snippet
    for a null or empty text. A document's id must be unique.
    """
    entry = F.struct("pos", F.struct(F.col("surface").alias("text"), "uri", "types", "confidence").alias("e"))
    entities = mentions.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias("entities"))
    chosen = mentions if max_entities is None else top_entities(mentions, max_entities, id_col)
    last = chosen.groupBy(id_col, "surface").agg(F.max_by(F.struct("uri", "types"), "pos").alias("_l")).select(id_col, "surface", "_l.*")
    # Written, so that the planner knows its size: sent to the mentions if small, which then stay by text.
    listed = materialized(relations.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct("relation", "target"))).alias("relations")), "relations")
    mapped = last.join(listed, "uri").groupBy(id_col).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("surface", F.struct("uri", "types", "relations").alias("value"))))).alias("relations"))
    whole = docs.select(id_col, F.when(F.length(text) > 0, snippet(text)).alias("text_snippet"))
    out = whole.join(entities, id_col, "left").join(mapped, id_col, "left")
    return out.withColumn("entities", F.coalesce("entities", F.array().cast(entities.schema["entities"].dataType))).withColumn(
        "relations", F.coalesce("relations", F.create_map().cast(mapped.schema["relations"].dataType)))
