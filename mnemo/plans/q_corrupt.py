"""Corrupted copies of the documents' contexts, least likely tokens by the counts of the training documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import detokenize, first_tokens
from ..operators.corruption import corrupt_token_candidates
from .catalog import register
from .q_scores import K, P, training_docs
from .sqlparts import model_ctes, tokens_sql
from .tables import table


@register(
    "corrupt_candidates",
    "O39",
    f"""WITH {model_ctes(K)},
vocab AS MATERIALIZED (
  SELECT token, n, row_number() OVER (ORDER BY n, token) AS rank
  FROM (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM train_toks) GROUP BY token)
),
ctx AS (SELECT doc_id, list_slice({tokens_sql('text')}, 1, {P}) AS toks FROM documents),
places AS (SELECT doc_id, toks, unnest(generate_series(1, len(toks) - 1)) AS position FROM ctx WHERE len(toks) > 1),
asked AS MATERIALIZED (
  SELECT doc_id, position, n, array_to_string(list_slice(toks, position - n + 1, position), ' ') AS state
  FROM (SELECT *, unnest(generate_series(1, least(position, {K}))) AS n FROM places)
),
seen AS MATERIALIZED (
  SELECT g.state, v.rank, g.cnt, v.n, g.nxt FROM grams g JOIN vocab v ON v.token = g.nxt WHERE g.state IN (SELECT state FROM asked)
),
free AS (
  SELECT s.state, min(s.r) AS rank
  FROM (SELECT state, unnest(generate_series(1, count(*) + 1)) AS r FROM seen GROUP BY state) s
  LEFT JOIN seen f ON f.state = s.state AND f.rank = s.r WHERE f.state IS NULL GROUP BY s.state
),
least_seen AS (SELECT state, arg_min(nxt, row(cnt, n, nxt)) AS nxt FROM seen GROUP BY state),
candidates AS (
  SELECT f.state, coalesce(v.token, l.nxt) AS candidate FROM free f LEFT JOIN vocab v ON v.rank = f.rank JOIN least_seen l ON l.state = f.state
),
best AS (SELECT a.doc_id, a.position, arg_max(c.candidate, a.n) AS candidate FROM asked a JOIN candidates c ON c.state = a.state GROUP BY ALL)
SELECT p.doc_id, p.position::INT AS position, p.toks[p.position + 1] AS token, c AS candidate,
       array_to_string(list_concat(list_slice(p.toks, 1, p.position), [c], list_slice(p.toks, p.position + 2, len(p.toks))), ' ') AS corrupted
FROM (
  SELECT p.*, coalesce(b.candidate, (SELECT token FROM vocab WHERE rank = 1)) AS c
  FROM places p LEFT JOIN best b ON b.doc_id = p.doc_id AND b.position = p.position
) p""",
)
def corrupt_candidates(spark: SparkSession, sf: str) -> DataFrame:
    contexts = table(spark, sf, "documents", light=True).select("doc_id", first_tokens("text", P).alias("tokens"))
    out = corrupt_token_candidates(contexts, training_docs(spark, sf), K)
    return out.select("doc_id", "position", "token", "candidate", detokenize("corrupted").alias("corrupted"))
