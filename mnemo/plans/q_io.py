"""Source/sink round trips through fresh folders under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import tokenize
from ..operators.filtering import cheap_rule, middle_split
from ..operators.relational import contiguous_shards, dedup_first
from ..session import materialized, scratch_path
from ..sources.io import (
    PAIR_SCHEMA,
    export_prompt_documents,
    extract_fenced_block,
    materialize_once,
    read_filtered_ids,
    read_jsonl_corpus,
    read_parquet_parts,
    read_prompt_pairs,
    read_scores,
    read_tagged_rows,
    union_job_outputs,
    write_filtered_ids,
    write_prompt_pairs,
    write_records_json,
    write_tagged_rows,
)
from .catalog import register
from .q_patterns import RULES_SQL, _rule_case
from .sqlparts import tokens_sql
from .tables import table


@register("jsonl_roundtrip", "O01 O04 O08",
          "SELECT doc_id, length(text) AS n_chars FROM documents")
def jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "corpus")
    write_records_json(table(spark, sf, "documents").select("doc_id", "text"), path)
    back = read_jsonl_corpus(spark, path)
    return back.select("doc_id", F.length("text").alias("n_chars"))


@register(
    "pairs_roundtrip",
    "O05 O10",
    """SELECT a.conv_id * 1000 + a.turn AS pair_id, length(a.text) AS clean_len, length(b.text) AS corrupt_len
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2""",
)
def pairs_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("clean"))
    b = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("corrupt"))
    pairs = a.join(b, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "clean", "corrupt",
        F.slice(tokenize("clean"), 1, 1).alias("answers"), F.slice(tokenize("corrupt"), 1, 1).alias("wrong_answers"),
        F.lit(None).cast("double").alias("similarity_score"))
    path = scratch_path(spark, "pairs")
    write_prompt_pairs(pairs, path)
    back = read_prompt_pairs(spark, path, schema=KEYED_PAIRS)
    return back.select("pair_id", F.length("clean").alias("clean_len"), F.length("corrupt").alias("corrupt_len"))


KEYED_PAIRS = T.StructType([T.StructField("pair_id", T.LongType()), *PAIR_SCHEMA.fields])


@register(
    "pairs_documents",
    "O05 O10",
    f"""WITH c AS (SELECT conv_id, turn, text, {tokens_sql('text')} AS toks FROM conversations)
SELECT a.conv_id * 1000 + a.turn AS pair_id, a.text AS clean, b.text AS corrupt, a.toks[1] AS answer, b.toks[1] AS wrong_answer
FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
)
def pairs_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's pairs of turns as one document of prompts, written and read back."""
    c = table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("corrupt"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("clean")).join(nxt, ["conv_id", "turn"]).select(
        "conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "clean", "corrupt",
        F.slice(tokenize("clean"), 1, 1).alias("answers"), F.slice(tokenize("corrupt"), 1, 1).alias("wrong_answers"))
    path = scratch_path(spark, "prompts")
    export_prompt_documents(pairs, path, "conv_id")
    back = read_prompt_pairs(spark, path, document=True, schema=KEYED_PAIRS)
    return back.select("pair_id", "clean", "corrupt", F.get("answers", F.lit(0)).alias("answer"), F.get("wrong_answers", F.lit(0)).alias("wrong_answer"))


@register(
    "score_files",
    "O02 O03",
    """SELECT 'parquet' AS source, doc_id, n_chars / 10.0::DOUBLE AS score FROM documents
UNION ALL SELECT 'json', doc_id, n_chars / 10.0::DOUBLE FROM documents""",
)
def score_files(spark: SparkSession, sf: str) -> DataFrame:
    """A score table as one Parquet folder a rank and as JSON arrays, read back by name."""
    scores = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 10.0).alias("score"))
    root = scratch_path(spark, "scores")
    ranks = [f"{root}/rank{r}.parquet" for r in range(3)]
    for r, path in enumerate(ranks):
        scores.where(F.pmod("doc_id", F.lit(3)) == r).write.parquet(path)
    arrays = scores.groupBy(F.floor(F.col("doc_id") / 100).alias("file")).agg(F.to_json(F.collect_list(F.struct("doc_id", "score"))).alias("value"))
    arrays.write.partitionBy("file").text(f"{root}/arrays.json")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    parts = read_parquet_parts(spark, ranks[:2]).unionByName(read_scores(spark, ranks[2]))
    listed = read_scores(spark, f"{root}/arrays.json", schema)
    return parts.select(F.lit("parquet").alias("source"), "doc_id", "score").unionByName(listed.select(F.lit("json").alias("source"), "doc_id", "score"))


@register(
    "parts_union",
    "O13 O02 O62",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS total FROM documents)
SELECT 'job' || least((rn - 1) // (total // 3), 2) AS part, doc_id, CASE least((rn - 1) // (total // 3), 2) WHEN 0 THEN 'found' ELSE 'unexpected' END AS status
FROM r WHERE least((rn - 1) // (total // 3), 2) <> 1
UNION ALL SELECT 'job1', NULL, 'missing' UNION ALL SELECT 'job3', NULL, 'empty'""",
)
def parts_union(spark: SparkSession, sf: str) -> DataFrame:
    shards = contiguous_shards(table(spark, sf, "documents").select("doc_id"), 3, ["doc_id"])
    root = scratch_path(spark, "jobs")
    for job in (0, 2, 3):  # job 1 never finished: its part is missing; job 3 had nothing to write; nobody asked for job 2
        shards.where(F.col("shard") == job).drop("shard").write.parquet(f"{root}/job{job}")
    expected = spark.createDataFrame([("job0",), ("job1",), ("job3",)], "part string")
    return union_job_outputs(spark, root, expected, T.StructType([T.StructField("doc_id", T.LongType())])).select("part", "doc_id", "status")


@register(
    "materialize_once",
    "O14 O55",
    "SELECT min(doc_id) AS doc_id, count(*) - 1 AS duplicates FROM documents GROUP BY text, lang, source",
)
def materialize_once_q(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "dedup")

    def build():
        d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
        return dedup_first(d, ["text", "lang", "source"], ["doc_id"]).select("doc_id", "duplicates")

    materialize_once(spark, path, build)
    return materialize_once(spark, path, build)  # second call reads the finished output


@register(
    "tagged_rows",
    "O06 O11",
    """SELECT doc_id::VARCHAR AS row_id, length(array_to_string(list_slice(ls, 1, len(ls) // 2), chr(10))) AS text_len,
       length(array_to_string(list_slice(ls, len(ls) // 2 + 1, len(ls)), chr(10))) AS completion_len
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""",
)
def tagged_rows(spark: SparkSession, sf: str) -> DataFrame:
    pairs = middle_split(table(spark, sf, "documents"))
    path = scratch_path(spark, "tagged")
    write_tagged_rows(pairs, path)
    back = read_tagged_rows(spark, path)
    # The writer puts the text on its own lines: strip the framing newlines it added.
    t = F.regexp_replace(F.regexp_replace("text", "^\n", ""), "\n$", "")
    return back.select("row_id", F.length(t).alias("text_len"), F.length("completion").alias("completion_len"))


@register(
    "kept_rows_text",
    "O11 O76",
    f"""WITH {RULES_SQL}, r AS (SELECT row_id, {_rule_case()} AS rule FROM rules),
ls AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
SELECT r.row_id::VARCHAR AS row_id, r.rule IS NULL AS kept,
       CASE WHEN r.rule IS NULL THEN length(array_to_string(list_slice(ls, 1, len(ls) // 2), chr(10))) END AS text_len,
       CASE WHEN r.rule IS NULL THEN length(array_to_string(list_slice(ls, len(ls) // 2 + 1, len(ls)), chr(10))) END AS completion_len
FROM r JOIN ls ON ls.doc_id = r.row_id""",
)
def kept_rows_text(spark: SparkSession, sf: str) -> DataFrame:
    """Kept rows as tagged text and the ids of the others, both read back; by the rules in SQL's reach."""
    pairs = middle_split(table(spark, sf, "documents"))
    classified = materialized(pairs.withColumn("rule", cheap_rule(F.col("text"), F.col("completion"))), "classified")
    root = scratch_path(spark, "filtered")
    write_tagged_rows(classified.where(F.col("rule").isNull()), f"{root}/kept")
    write_filtered_ids(classified.where(F.col("rule").isNotNull()), f"{root}/ids")
    t = F.regexp_replace(F.regexp_replace("text", "^\n", ""), "\n$", "")
    kept = read_tagged_rows(spark, f"{root}/kept").select(
        "row_id", F.lit(True).alias("kept"), F.length(t).alias("text_len"), F.length("completion").alias("completion_len"))
    others = read_filtered_ids(spark, f"{root}/ids").select("row_id", F.lit(False).alias("kept"))
    return kept.unionByName(others, allowMissingColumns=True)


@register(
    "fenced_block",
    "O07",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN length(text)
  WHEN doc_id % 3 = 1 THEN CASE WHEN contains(text, '```') THEN strpos(text, '```') - 1 ELSE length(text) END
  ELSE length(text) + length('<file_contents>') END AS n_chars, 
  md5(CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN CASE WHEN contains(text, '```') THEN left(text, strpos(text, '```') - 1) ELSE text END
  ELSE '<file_contents>' || text END) AS digest
FROM documents""",
)
def fenced_block(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the documents as they are, a third fenced under the marker, a third with the marker and no fence."""
    k = F.pmod("doc_id", F.lit(3))
    fenced = F.concat(F.lit("intro <file_contents>\n```data/mem/examples.txt\n"), "text", F.lit("```\nafter"))
    built = F.when(k == 1, fenced).when(k == 2, F.concat(F.lit("<file_contents>"), "text")).otherwise(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", extract_fenced_block(built).alias("body"))
    return d.select("doc_id", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("digest"))
