"""DuckDB SQL fragments used by the oracle side of the query catalogue.

Each function returns CTE text that mirrors one Spark operator, so the oracle queries stay
readable and the same parameters drive both sides.
"""

from __future__ import annotations

# Same whitespace class as mnemo.functions.tokens.WHITESPACE.
WS = "[ \\t\\n\\x0B\\f\\r]+"


def tokens_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{WS}'), lambda x: x <> '')"


def model_ctes(k: int) -> str:
    """CTEs ``train_toks``, ``grams``, ``model(state, nxt)`` for the n-gram continuation table.

    Training corpus = documents labelled quality = 1.
    """
    return f"""
train_toks AS MATERIALIZED (
  SELECT {tokens_sql('d.text')} AS toks
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1
),
grams AS (
  SELECT array_to_string(list_slice(toks, i + 1, i + n), ' ') AS state, toks[i + n + 1] AS nxt, count(*) AS cnt
  FROM (
    SELECT toks, n, unnest(generate_series(0, len(toks) - n - 1)) AS i
    FROM (SELECT toks, unnest(generate_series(1, {k})) AS n FROM train_toks)
    WHERE len(toks) > n
  )
  GROUP BY ALL
),
model AS MATERIALIZED (
  SELECT state, nxt FROM (
    SELECT state, nxt, row_number() OVER (PARTITION BY state ORDER BY cnt DESC, nxt) AS rn FROM grams
  ) WHERE rn = 1
)"""


def walk_ctes(starts: str, k: int, max_steps: int, name: str = "walk") -> str:
    """Recursive greedy walk.

    ``starts`` must be a CTE with columns ``(wid, st LIST, need)``. Produces ``{name}_final(wid, gen)``.
    """
    return f"""
{name} AS (
  SELECT wid, st, need, []::VARCHAR[] AS gen, 0 AS step FROM {starts}
  UNION ALL
  SELECT w.wid,
         list_slice(list_append(w.st, m.nxt), greatest(len(w.st) + 1 - {k} + 1, 1), len(w.st) + 1),
         w.need, list_append(w.gen, m.nxt), w.step + 1
  FROM {name} w JOIN model m ON m.state = array_to_string(w.st, ' ')
  WHERE w.step < w.need AND w.step < {max_steps}
),
{name}_final AS (
  SELECT wid, arg_max(gen, step) AS gen FROM {name} GROUP BY wid
)"""


def match_count_sql(gen: str, truth: str) -> str:
    return f"coalesce(list_sum(list_transform(generate_series(1, len({truth})), lambda j: CASE WHEN {gen}[j] = {truth}[j] THEN 1 ELSE 0 END)), 0)"


def scores_ctes(P: int, G: int, k: int) -> str:
    """CTEs up to ``scores(doc_id, status, context, completion, true_completion, memorization_score, in_training)``."""
    return f"""
{model_ctes(k)},
doc_toks AS (
  SELECT doc_id, coalesce({tokens_sql('text')}, []) AS toks FROM documents
),
prompts AS (
  SELECT doc_id, list_slice(toks, 1, {P}) AS context, list_slice(toks, {P} + 1, {P} + {G}) AS true_completion,
         CASE WHEN len(toks) >= {P} + {G} THEN 'full' ELSE 'short' END AS status
  FROM doc_toks
),
starts AS (
  SELECT doc_id AS wid, list_slice(context, greatest(len(context) - {k} + 1, 1), len(context)) AS st, {G} AS need
  FROM prompts
),
{walk_ctes('starts', k, G)},
scores AS (
  SELECT p.doc_id, p.status, p.context, p.true_completion, coalesce(w.gen, []::VARCHAR[]) AS completion,
         {match_count_sql('coalesce(w.gen, []::VARCHAR[])', 'p.true_completion')}::DOUBLE / {G} AS memorization_score,
         coalesce(l.quality = 1, false) AS in_training
  FROM prompts p LEFT JOIN walk_final w ON w.wid = p.doc_id
  LEFT JOIN labels l ON l.doc_id = p.doc_id
)"""
