"""Pattern-filter queries over documents split at their middle line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import (
    DIGITS_FROM,
    DIGITS_TO,
    PY_WS,
    SCRIPT_LABELS,
    SCRIPT_RANGES,
    STRUCTURE_PATTERNS_PY,
    dominant_script,
    is_line_by_line_sequential,
    is_repeated_text,
    is_repetitive,
    is_sequential_numbers,
    matched_structure,
    non_latin,
    portable,
    skeleton_lines,
)
from ..operators.filtering import script_histogram, cheap_rule, classify, filter_summary, middle_split, skeleton_similarity
from .catalog import register
from .tables import table


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return middle_split(table(spark, sf, "documents"))


# ---- DuckDB side -------------------------------------------------------------------------

PAIRS_SQL = """
pairs AS (
  SELECT doc_id AS row_id,
         array_to_string(list_slice(ls, 1, len(ls) // 2), chr(10)) AS text,
         array_to_string(list_slice(ls, len(ls) // 2 + 1, len(ls)), chr(10)) AS completion
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
)"""


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{PY_WS}+|{PY_WS}+\\z', '', 'g')"


def s_numbers(x: str) -> str:
    """HUGEINT, the widest integer here (38 digits); longer numbers are held against Python in the tests."""
    return (
        f"list_transform(list_filter(regexp_split_to_array({x}, '[^\\p{{L}}\\p{{N}}_]+'), "
        f"lambda w: regexp_full_match(w, '\\p{{Nd}}+')), "
        f"lambda w: TRY_CAST(translate(w, '{DIGITS_FROM}', '{DIGITS_TO}') AS HUGEINT))"
    )


def s_forall(lst: str, pred: str) -> str:
    return f"coalesce(list_bool_and(list_transform({lst}, {pred})), true)"


def s_no_nulls(lst: str) -> str:
    return f"(len(list_filter({lst}, lambda x: x IS NULL)) = 0)"


def s_increments(nl: str) -> str:
    return (
        f"flatten(list_transform(list_filter(generate_series(2, greatest(len({nl}), 2)), "
        f"lambda i: len({nl}) >= i AND len({nl}[i]) = len({nl}[i - 1])), "
        f"lambda i: list_transform(generate_series(1, len({nl}[i])), lambda j: {nl}[i][j] - {nl}[i - 1][j])))"
    )


def s_nonspace(x: str) -> str:
    return f"list_distinct(regexp_extract_all(regexp_replace({x}, '{PY_WS}+', '', 'g'), '(?s).'))"


def s_nonlatin(x: str) -> str:
    return f"regexp_replace({x}, '[\\x00-\\x7F]+', '', 'g')"


def s_script(ch: str) -> str:
    out = "'Other'"
    for label, lo, hi in reversed(SCRIPT_RANGES):
        out = f"CASE WHEN unicode({ch}) BETWEEN {lo} AND {hi} THEN '{label}' ELSE {out} END"
    return out


def s_dominant(x: str) -> str:
    scripts = f"list_transform(regexp_extract_all({s_nonlatin(x)}, '(?s).'), lambda ch: {s_script('ch')})"
    cands = ", ".join(
        f"{{'n': len(list_filter(sc, lambda v: v = '{lab}')), 'f': -list_position(sc, '{lab}'), 's': '{lab}'}}"
        for lab in SCRIPT_LABELS
    )
    return f"(SELECT list_sort(list_filter([{cands}], lambda c: c.n > 0), 'DESC')[1].s FROM (SELECT {scripts} AS sc))"


def s_repetitive(x: str) -> str:
    cnt = f"((length({x}) - length(replace({x}, left({x}, L::BIGINT), ''))) / L)"
    return (
        f"(length({x}) >= 4 AND len(list_filter(generate_series(2, greatest(length({x}) // 2, 2)), "
        f"lambda L: {cnt} > 1 AND {cnt} * L > length({x}) / 2)) > 0)"
    )


def s_density(x: str, p: str) -> str:
    return f"(len(regexp_extract_all({x}, '{p}')) / greatest(len(string_split({x}, chr(10))), 1) > 0.3)"


SQL_PATTERNS = ["(?m)" + portable(p).replace("'", "''") for p in STRUCTURE_PATTERNS_PY]

RULES_SQL = f"""
{PAIRS_SQL},
p1 AS (
  SELECT *, {s_numbers('text')} AS tn, {s_numbers('completion')} AS cn,
         {s_strip('text')} AS ts, {s_strip('completion')} AS cs
  FROM pairs
),
p2 AS (
  SELECT *, string_split(ts, chr(10)) AS tls, string_split(cs, chr(10)) AS cls,
         list_filter(regexp_split_to_array(text, '{PY_WS}+'), lambda w: w <> '') AS tw,
         list_filter(regexp_split_to_array(completion, '{PY_WS}+'), lambda w: w <> '') AS cw
  FROM p1
),
p3 AS (
  SELECT *, list_filter(list_transform(tls, lambda l: {s_numbers('l')}), lambda a: len(a) > 0) AS tl,
         list_filter(list_transform(cls, lambda l: {s_numbers('l')}), lambda a: len(a) > 0) AS cl
  FROM p2
),
p4 AS (SELECT *, {s_increments('tl')} AS ti, {s_increments('cl')} AS ci FROM p3),
rules AS (
  SELECT row_id, text, completion,
    coalesce(len(tn) > 0 AND len(cn) > 0 AND {s_no_nulls('tn')} AND {s_no_nulls('cn')} AND (
      {s_forall('generate_series(1, len(cn))', 'lambda i: cn[i] = tn[len(tn)] + i')}
      OR (len(cn) > 1 AND {s_forall('generate_series(2, len(cn))', 'lambda i: cn[i] = cn[i - 1] + 1')})
    ), false) AS seq_numbers,
    coalesce(len(tls) >= 2 AND len(cls) >= 2 AND len(tl) >= 2 AND len(cl) >= 2
      AND {s_no_nulls('flatten(list_concat(tl, cl))')} AND (
        (len(ti) > 0 AND len(ci) > 0 AND {s_forall('ti', 'lambda x: x = ti[1]')}
         AND {s_forall('ci', 'lambda x: x = ci[1]')} AND ti[1] = ci[1])
        OR (len(tl[len(tl)]) = len(cl[1]) AND {s_forall(
            'generate_series(1, len(cl[1]))',
            'lambda j: tl[len(tl)][j] + CASE WHEN len(ti) > 0 AND len(ci) > 0 THEN ti[1] ELSE 1 END = cl[1][j]')})
      ), false) AS line_sequences,
    coalesce(length(text) > 0 AND length(completion) > 0 AND (
      ts = cs
      OR (len(tw) >= 3 AND len(cw) >= 3 AND len(list_filter(generate_series(1, len(tw) - 2),
          lambda i: contains(array_to_string(cw, ' '), array_to_string(list_slice(tw, i, i + 2), ' ')))) > 0)
      OR contains(cs, array_to_string(list_slice(tls, greatest(len(tls) - 2, 1), len(tls)), chr(10)))
      OR (length(text) > 3 AND length(completion) > 3 AND len({s_nonspace('text')}) = 1
          AND len({s_nonspace('completion')}) = 1 AND {s_nonspace('text')}[1] = {s_nonspace('completion')}[1])
    ), false) AS repeated_text,
    CASE {' '.join(f"WHEN {s_density('text', p)} AND {s_density('completion', p)} THEN {i}" for i, p in enumerate(SQL_PATTERNS))}
    END AS structure,
    coalesce(length({s_nonlatin('text')}) > 0 AND length({s_nonlatin('completion')}) > 0
      AND {s_dominant('text')} = {s_dominant('completion')}
      AND {s_repetitive(s_nonlatin('text'))} AND {s_repetitive(s_nonlatin('completion'))}, false) AS script_repetition
  FROM p4
)"""


def _rule_case() -> str:
    return (
        "CASE WHEN seq_numbers THEN 'sequential_numbers' WHEN line_sequences THEN 'line_by_line_sequential' "
        "WHEN repeated_text THEN 'repeated_text' WHEN structure IS NOT NULL OR script_repetition "
        "THEN 'simple_structure' END"
    )


# ---- queries -------------------------------------------------------------------------------

@register("seq_numbers", "O68", f"WITH {RULES_SQL} SELECT row_id, seq_numbers FROM rules")
def seq_numbers_q(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("row_id", is_sequential_numbers("text", "completion").alias("seq_numbers"))


@register("line_sequences", "O69", f"WITH {RULES_SQL} SELECT row_id, line_sequences FROM rules")
def line_sequences_q(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("row_id", is_line_by_line_sequential("text", "completion").alias("line_sequences"))


@register("repeated_text", "O70", f"WITH {RULES_SQL} SELECT row_id, repeated_text FROM rules")
def repeated_text_q(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("row_id", is_repeated_text("text", "completion").alias("repeated_text"))


@register("structure_patterns", "O71", f"WITH {RULES_SQL} SELECT row_id, structure FROM rules")
def structure_patterns_q(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("row_id", matched_structure("text", "completion").alias("structure"))


@register(
    "scripts",
    "O73",
    f"WITH {PAIRS_SQL} SELECT row_id, {s_dominant('text')} AS text_script, "
    f"{s_dominant('completion')} AS completion_script FROM pairs",
)
def scripts_q(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select(
        "row_id", dominant_script("text").alias("text_script"), dominant_script("completion").alias("completion_script")
    )


@register(
    "repetitive",
    "O74",
    f"WITH {PAIRS_SQL} SELECT row_id, {s_repetitive(s_nonlatin('text'))} AS text_repetitive, "
    f"{s_repetitive(s_nonlatin('completion'))} AS completion_repetitive FROM pairs",
)
def repetitive_q(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select(
        "row_id",
        is_repetitive(non_latin("text")).alias("text_repetitive"),
        is_repetitive(non_latin("completion")).alias("completion_repetitive"),
    )


@register("cheap_rules", "O68-O71 O73-O75", f"WITH {RULES_SQL} SELECT row_id, {_rule_case()} AS rule FROM rules")
def cheap_rules_q(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("row_id", cheap_rule(F.col("text"), F.col("completion")).alias("rule"))


@register("skeleton_similarity", "O72")
def skeleton_similarity_q(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf)
    return p.select(
        "row_id",
        F.round(skeleton_similarity(skeleton_lines("text"), skeleton_lines("completion")), 6).alias("similarity"),
    )


@register("simple_pattern", "O75 O76")
def simple_pattern_q(spark: SparkSession, sf: str) -> DataFrame:
    return classify(pairs(spark, sf)).select("row_id", "rule")


@register("filter_summary", "O54 O76")
def filter_summary_q(spark: SparkSession, sf: str) -> DataFrame:
    return filter_summary(classify(pairs(spark, sf)))


@register(
    "filter_summary_rules",
    "O54 O75 O76",
    f"""WITH {RULES_SQL}, r AS (SELECT {_rule_case()} AS rule FROM rules)
SELECT count(*) AS total, count(rule) AS filtered, count(*) - count(rule) AS kept, round(count(rule) * 100.0::DOUBLE / nullif(count(*), 0), 6) AS filtered_pct FROM r""",
)
def filter_summary_rules_q(spark: SparkSession, sf: str) -> DataFrame:
    return filter_summary(classify(pairs(spark, sf), similar=False))


@register(
    "script_histogram",
    "O73",
    f"""SELECT doc_id, script, count(*) AS n FROM (
  SELECT doc_id, unnest(list_transform(regexp_extract_all({s_nonlatin('text')}, '(?s).'), lambda ch: {s_script('ch')})) AS script FROM documents
) GROUP BY ALL""",
)
def script_histogram_q(spark: SparkSession, sf: str) -> DataFrame:
    return script_histogram(table(spark, sf, "documents"), "doc_id")
