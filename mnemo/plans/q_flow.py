"""Contribution and contribution-graph queries.

Vectors: ``embeddings`` grouped by label (parts = members, whole = their sum plus extras).
Graphs: one per user in ``events``: token = event type (alphabetical rank), layer = quarter of
the day, head = value > 10. Attention weight from token f to token t >= f in a layer is the
sum of f's values there divided by (1 + t - f); residual weight is 1 + event count; ffn
weight is the sum of the head-1 values. Shares normalise these per representation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contributions import contributions, threshold_renormalize, vector_sum, with_one_off
from ..operators.flow import attention_contributions, build_full_graph, component_contributions, mlp_contributions
from ..operators.graph import best_to_target, edges_above, graph_edges, graph_nodes, level, reach
from ..operators.relational import global_rank
from .catalog import register
from .tables import table

THRESHOLD = 0.05

# ---- vectors ---------------------------------------------------------------------------------


def _parts(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("label").alias("group"), F.lit("part").alias("kind"), F.col("vec_id").alias("part_id"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def _mean(parts: DataFrame) -> DataFrame:
    s = vector_sum(parts, ["group"], "vec", "sum")
    n = parts.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    return s.join(n, "group").select("group", F.transform("sum", lambda x: x / F.col("n")).alias("vec"))


def _elementwise_max(parts: DataFrame) -> DataFrame:
    cells = parts.select("group", F.posexplode("vec").alias("_d", "_x"))
    m = cells.groupBy("group", "_d").agg(F.max("_x").alias("_m"))
    return m.groupBy("group").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias("vec"))


def residual_parts(spark, sf):
    parts = _parts(spark, sf)
    return with_one_off(parts, _mean(parts), "residual")


def kinds_parts(spark, sf):
    parts = _parts(spark, sf)
    return with_one_off(with_one_off(parts, _elementwise_max(parts), "mlp"), _mean(parts), "residual")


def _shares(all_parts: DataFrame) -> DataFrame:
    whole = vector_sum(all_parts, ["group"], "vec", "vec")
    return contributions(all_parts, whole, "group", p=1, eps=1e-6)


VEC_SQL = """
parts AS (SELECT label AS grp, 'part' AS kind, vec_id AS part_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec
          FROM embeddings),
cells AS (SELECT grp, unnest(generate_series(1, len(vec))) AS d, unnest(vec) AS v FROM parts),
meanv AS (SELECT grp, list(m ORDER BY d) AS vec FROM (SELECT grp, d, sum(v) / count(*) AS m FROM cells GROUP BY ALL) GROUP BY grp),
maxv AS (SELECT grp, list(m ORDER BY d) AS vec FROM (SELECT grp, d, max(v) AS m FROM cells GROUP BY ALL) GROUP BY grp)"""


def _vec_shares_sql(parts_expr: str) -> str:
    return f"""
allp AS ({parts_expr}),
acells AS (SELECT grp, unnest(generate_series(1, len(vec))) AS d, unnest(vec) AS v FROM allp),
whole AS (SELECT grp, list(s ORDER BY d) AS vec FROM (SELECT grp, d, sum(v) AS s FROM acells GROUP BY ALL) GROUP BY grp),
dd AS (
  SELECT p.grp, p.kind, p.part_id,
         greatest(list_sum(list_transform(w.vec, lambda x: abs(x)))
                  - list_sum(list_transform(generate_series(1, len(p.vec)), lambda i: abs(p.vec[i] - w.vec[i] + 1e-6))),
                  1e-5) AS d
  FROM allp p JOIN whole w USING (grp)
),
shares AS (SELECT grp, kind, part_id, d / sum(d) OVER (PARTITION BY grp) AS share FROM dd)"""


RESID_PARTS_SQL = "SELECT * FROM parts UNION ALL SELECT grp, 'residual', -1, vec FROM meanv"
KINDS_PARTS_SQL = RESID_PARTS_SQL + " UNION ALL SELECT grp, 'mlp', -1, vec FROM maxv"


@register(
    "contributions",
    "O81",
    f"WITH {VEC_SQL}, {_vec_shares_sql('SELECT * FROM parts')} "
    "SELECT grp AS label, part_id AS vec_id, round(share, 6) AS share FROM shares",
)
def contributions_q(spark: SparkSession, sf: str) -> DataFrame:
    s = _shares(_parts(spark, sf))
    return s.select(F.col("group").alias("label"), F.col("part_id").alias("vec_id"), F.round("share", 6).alias("share"))


@register(
    "contributions_residual",
    "O82 O83 O85 O86",
    f"WITH {VEC_SQL}, {_vec_shares_sql(RESID_PARTS_SQL)} "
    "SELECT grp AS label, kind, part_id, round(share, 6) AS share FROM shares",
)
def contributions_residual_q(spark: SparkSession, sf: str) -> DataFrame:
    s = _shares(residual_parts(spark, sf))
    return s.select(F.col("group").alias("label"), "kind", "part_id", F.round("share", 6).alias("share"))


@register(
    "contributions_kinds",
    "O84",
    f"WITH {VEC_SQL}, {_vec_shares_sql(KINDS_PARTS_SQL)} "
    "SELECT grp AS label, kind, part_id, round(share, 6) AS share FROM shares",
)
def contributions_kinds_q(spark: SparkSession, sf: str) -> DataFrame:
    s = _shares(kinds_parts(spark, sf))
    return s.select(F.col("group").alias("label"), "kind", "part_id", F.round("share", 6).alias("share"))


@register(
    "threshold_renormalize",
    "O87 O88",
    f"""WITH {VEC_SQL}, {_vec_shares_sql(KINDS_PARTS_SQL)},
kept AS (SELECT *, CASE WHEN share > 0.02 THEN share ELSE 0.0 END AS k FROM shares)
SELECT grp AS label, kind, part_id, round(k / nullif(sum(k) OVER (PARTITION BY grp), 0), 6) AS share FROM kept""",
)
def threshold_renormalize_q(spark: SparkSession, sf: str) -> DataFrame:
    s = threshold_renormalize(_shares(kinds_parts(spark, sf)), 0.02, "group")
    return s.select(F.col("group").alias("label"), "kind", "part_id", F.round("share", 6).alias("share"))


# ---- graphs from events ----------------------------------------------------------------------


def graph_inputs(spark: SparkSession, sf: str):
    """Per-head attention weights and per-(graph, layer, token) base weights."""
    ev = table(spark, sf, "events")
    types = global_rank(ev.select("event_type").distinct(), ["event_type"], "r")
    ev = ev.join(types.select("event_type", (F.col("r") - 1).cast("int").alias("tok")), "event_type")
    ev = ev.select(F.col("user_id").alias("graph_id"), (F.hour("ts") / 6).cast("int").alias("layer"), "tok",
                   F.when(F.col("value") > 10, 1).otherwise(0).alias("head"), "value")
    nl, nt = ev.agg(F.max("layer") + 1, F.max("tok") + 1).first()
    sizes = ev.select("graph_id").distinct().select("graph_id", F.lit(nl).alias("n_layers"), F.lit(nt).alias("n_tokens"))
    agg = ev.groupBy("graph_id", "layer", "tok", "head").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("c"))
    attn_raw = agg.select("graph_id", "layer", F.col("tok").alias("from_tok"), "head", "s",
                          F.explode(F.sequence(F.col("tok"), F.lit(nt - 1))).alias("to_tok")).select(
        "graph_id", "layer", "to_tok", "from_tok", "head", (F.col("s") / (1 + F.col("to_tok") - F.col("from_tok"))).alias("w"))
    grid = sizes.select("graph_id", F.explode(F.sequence(F.lit(0), F.lit(nl - 1))).alias("layer")).select(
        "graph_id", "layer", F.explode(F.sequence(F.lit(0), F.lit(nt - 1))).alias("token"))
    cnt = agg.groupBy("graph_id", "layer", F.col("tok").alias("token")).agg(
        F.sum("c").alias("c"), F.sum(F.when(F.col("head") == 1, F.col("s")).otherwise(0.0)).alias("s1"))
    asum = attn_raw.groupBy("graph_id", "layer", F.col("to_tok").alias("token")).agg(F.sum("w").alias("attn_sum"))
    base = grid.join(cnt, ["graph_id", "layer", "token"], "left").join(asum, ["graph_id", "layer", "token"], "left").select(
        "graph_id", "layer", "token",
        (1 + F.coalesce("c", F.lit(0))).cast("double").alias("resid"),
        F.coalesce("s1", F.lit(0.0)).alias("ffn"),
        F.coalesce("attn_sum", F.lit(0.0)).alias("attn_sum"))
    return sizes, attn_raw, base


def shares(spark: SparkSession, sf: str, parallel: bool = False, threshold: float | None = None):
    sizes, attn_raw, base = graph_inputs(spark, sf)
    if parallel:
        den = F.col("attn_sum") + F.col("ffn") + F.col("resid")
        b = base.select("graph_id", "layer", "token", (F.col("resid") / den).alias("resid_s"),
                        (F.col("ffn") / den).alias("ffn_s"), den.alias("attn_den"))
        ra, rf = b.select("graph_id", "layer", "token", F.col("resid_s").alias("share")), None
        rf = ra
        ffn = b.select("graph_id", "layer", "token", F.col("ffn_s").alias("share"))
    else:
        den = F.col("attn_sum") + F.col("resid")
        b = base.select("graph_id", "layer", "token", den.alias("attn_den"), "resid", "ffn")
        ra = b.select("graph_id", "layer", "token", (F.col("resid") / F.col("attn_den")).alias("share"))
        fden = F.col("ffn") + F.col("resid")
        ffn = b.select("graph_id", "layer", "token", (F.col("ffn") / fden).alias("share"))
        rf = b.select("graph_id", "layer", "token", (F.col("resid") / fden).alias("share"))
    attn = attn_raw.join(b.select("graph_id", "layer", F.col("token").alias("to_tok"), "attn_den"),
                         ["graph_id", "layer", "to_tok"]).select(
        "graph_id", "layer", "to_tok", "from_tok", "head", (F.col("w") / F.col("attn_den")).alias("share"))
    if threshold is not None and parallel:
        # Attention, feed-forward and residual of a token share one denominator.
        def one(part, df):
            return df.select("graph_id", "layer", "token", F.lit(-1).alias("from_tok"), F.lit(-1).alias("head"), "share",
                             F.lit(part).alias("part"))

        rep = attn.select("graph_id", "layer", F.col("to_tok").alias("token"), "from_tok", "head", "share",
                          F.lit("attn").alias("part")).unionByName(one("ffn", ffn)).unionByName(one("resid", ra))
        rep = threshold_renormalize(rep.withColumn("group", F.struct("graph_id", "layer", "token")), threshold, "group").drop("group")
        attn = rep.where(F.col("part") == "attn").select("graph_id", "layer", F.col("token").alias("to_tok"),
                                                          "from_tok", "head", "share")
        ffn, ra = (rep.where(F.col("part") == p).select("graph_id", "layer", "token", "share") for p in ("ffn", "resid"))
        rf = ra
    elif threshold is not None:
        # O87 per representation: attention blocks + residual share one denominator.
        a_rep = attn.select("graph_id", "layer", F.col("to_tok").alias("token"), "from_tok", "head", "share",
                            F.lit("attn").alias("part"))
        r_rep = ra.select("graph_id", "layer", "token", F.lit(-1).alias("from_tok"), F.lit(-1).alias("head"), "share",
                          F.lit("resid").alias("part"))
        rep = a_rep.unionByName(r_rep).withColumn("group", F.struct("graph_id", "layer", "token"))
        rep = threshold_renormalize(rep, threshold, "group").drop("group")
        attn = rep.where(F.col("part") == "attn").select("graph_id", "layer", F.col("token").alias("to_tok"),
                                                          "from_tok", "head", "share")
        ra = rep.where(F.col("part") == "resid").select("graph_id", "layer", "token", "share")
        f_rep = ffn.withColumn("part", F.lit("ffn")).unionByName(rf.withColumn("part", F.lit("resid")))
        f_rep = threshold_renormalize(f_rep.withColumn("group", F.struct("graph_id", "layer", "token")), threshold,
                                      "group").drop("group")
        ffn = f_rep.where(F.col("part") == "ffn").drop("part")
        rf = f_rep.where(F.col("part") == "resid").drop("part")
    return sizes, attn, ra, ffn, rf


def edges(spark: SparkSession, sf: str, parallel: bool = False, threshold: float | None = None) -> tuple:
    sizes, attn, ra, ffn, rf = shares(spark, sf, parallel, threshold)
    return sizes, graph_edges(attn, ra, ffn, rf, parallel)


GRAPH_SQL = """
ev AS (
  SELECT user_id AS graph_id, hour(ts) // 6 AS layer, dense_rank() OVER (ORDER BY event_type) - 1 AS tok,
         CASE WHEN value > 10 THEN 1 ELSE 0 END AS head, value
  FROM events
),
sz AS (SELECT max(layer) + 1 AS nl, max(tok) + 1 AS nt FROM ev),
graphs AS (SELECT DISTINCT graph_id FROM ev),
grid AS (
  SELECT g.graph_id, l.layer, t.token FROM graphs g
  JOIN (SELECT unnest(generate_series(0, (SELECT nl FROM sz) - 1)) AS layer) l ON true
  JOIN (SELECT unnest(generate_series(0, (SELECT nt FROM sz) - 1)) AS token) t ON true
),
agg AS (SELECT graph_id, layer, tok, head, sum(value) AS s, count(*) AS c FROM ev GROUP BY ALL),
attn_raw AS (
  SELECT graph_id, layer, to_tok, tok AS from_tok, head, s / (1 + to_tok - tok) AS w
  FROM (SELECT *, unnest(generate_series(tok, (SELECT nt FROM sz) - 1)) AS to_tok FROM agg)
),
cnt AS (SELECT graph_id, layer, tok AS token, sum(c) AS c, sum(CASE WHEN head = 1 THEN s ELSE 0.0 END) AS s1
        FROM agg GROUP BY ALL),
asum AS (SELECT graph_id, layer, to_tok AS token, sum(w) AS attn_sum FROM attn_raw GROUP BY ALL),
base AS (
  SELECT g.graph_id, g.layer, g.token, (1 + coalesce(c.c, 0))::DOUBLE AS resid, coalesce(c.s1, 0.0) AS ffn,
         coalesce(a.attn_sum, 0.0) AS attn_sum
  FROM grid g LEFT JOIN cnt c USING (graph_id, layer, token) LEFT JOIN asum a USING (graph_id, layer, token)
)"""


def _in_node(layer: str, tok: str) -> str:
    return f"CASE WHEN {layer} = 0 THEN 'X0_' || {tok} ELSE 'I' || ({layer} - 1) || '_' || {tok} END"


def _in_level(layer: str) -> str:
    return f"CASE WHEN {layer} = 0 THEN 0 ELSE ({layer} - 1) * 3 + 3 END"


def _edges_sql(parallel: bool) -> str:
    if parallel:
        sh = """
sh AS (SELECT *, attn_sum + ffn + resid AS attn_den, resid / (attn_sum + ffn + resid) AS ra,
              ffn / (attn_sum + ffn + resid) AS fs, resid / (attn_sum + ffn + resid) AS rf FROM base)"""
        blocks = f"""
  UNION ALL SELECT graph_id, 'A' || layer || '_' || token, 'I' || layer || '_' || token, layer * 3 + 1, layer * 3 + 3, ra FROM sh
  UNION ALL SELECT graph_id, {_in_node('layer', 'token')}, 'M' || layer || '_' || token, {_in_level('layer')}, layer * 3 + 2, fs FROM sh
  UNION ALL SELECT graph_id, 'M' || layer || '_' || token, 'I' || layer || '_' || token, layer * 3 + 2, layer * 3 + 3, fs FROM sh
  UNION ALL SELECT graph_id, {_in_node('layer', 'token')}, 'I' || layer || '_' || token, {_in_level('layer')}, layer * 3 + 3, rf FROM sh"""
    else:
        sh = """
sh AS (SELECT *, attn_sum + resid AS attn_den, resid / (attn_sum + resid) AS ra,
              ffn / (ffn + resid) AS fs, resid / (ffn + resid) AS rf FROM base)"""
        blocks = """
  UNION ALL SELECT graph_id, 'A' || layer || '_' || token, 'M' || layer || '_' || token, layer * 3 + 1, layer * 3 + 2, fs FROM sh
  UNION ALL SELECT graph_id, 'M' || layer || '_' || token, 'I' || layer || '_' || token, layer * 3 + 2, layer * 3 + 3, fs FROM sh
  UNION ALL SELECT graph_id, 'A' || layer || '_' || token, 'I' || layer || '_' || token, layer * 3 + 1, layer * 3 + 3, rf FROM sh"""
    return f"""{GRAPH_SQL},{sh},
attn AS (
  SELECT a.graph_id, a.layer, a.to_tok, a.from_tok, sum(a.w / s.attn_den) AS share
  FROM attn_raw a JOIN sh s ON s.graph_id = a.graph_id AND s.layer = a.layer AND s.token = a.to_tok
  GROUP BY ALL
),
raw_edges(graph_id, src, dst, src_level, dst_level, weight) AS (
  SELECT graph_id, {_in_node('layer', 'from_tok')}, 'A' || layer || '_' || to_tok, {_in_level('layer')}, layer * 3 + 1, share FROM attn
  UNION ALL SELECT graph_id, {_in_node('layer', 'token')}, 'A' || layer || '_' || token, {_in_level('layer')}, layer * 3 + 1, ra FROM sh
  {blocks}
),
edges AS (SELECT graph_id, src, dst, src_level, dst_level, sum(weight) AS weight FROM raw_edges GROUP BY ALL)"""


def _edge_out(e: DataFrame) -> DataFrame:
    return e.select("graph_id", "src", "dst", F.round("weight", 6).alias("weight"))


@register(
    "graph_nodes",
    "O89",
    f"""WITH {GRAPH_SQL}
SELECT graph_id, k || layer || '_' || token AS node FROM grid, (SELECT unnest(['A', 'M', 'I']) AS k)
UNION ALL SELECT DISTINCT graph_id, 'X0_' || token FROM grid""",
)
def graph_nodes_q(spark: SparkSession, sf: str) -> DataFrame:
    sizes, _, _ = graph_inputs(spark, sf)
    return graph_nodes(sizes).select("graph_id", "node")


@register("graph_edges_sequential", "O90 O91 O92",
          f"WITH {_edges_sql(False)} SELECT graph_id, src, dst, round(weight, 6) AS weight FROM edges")
def graph_edges_sequential_q(spark: SparkSession, sf: str) -> DataFrame:
    return _edge_out(edges(spark, sf, False)[1])


@register("graph_edges_parallel", "O90 O91 O92",
          f"WITH {_edges_sql(True)} SELECT graph_id, src, dst, round(weight, 6) AS weight FROM edges")
def graph_edges_parallel_q(spark: SparkSession, sf: str) -> DataFrame:
    return _edge_out(edges(spark, sf, True)[1])


@register(
    "edges_above",
    "O94",
    f"WITH {_edges_sql(False)} SELECT graph_id, count(*) AS n_edges FROM edges WHERE weight > 0.1 GROUP BY graph_id",
)
def edges_above_q(spark: SparkSession, sf: str) -> DataFrame:
    return edges_above(edges(spark, sf, False)[1], 0.1).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))


# ---- graphs from vectors -----------------------------------------------------------------------

# The residual stream before layer l at position p of graph g is embedding (g * LAYERS + l) * TOKENS + p. A head's part from key
# position q <= p is the key's vector times (head + 1) / (2 * (1 + p - q)); the feed-forward block is half the positive part.
LAYERS, TOKENS, HEADS, COMPONENTS = 2, 4, 2, 4


def flow_vectors(spark: SparkSession, sf: str, parallel: bool) -> dict[str, DataFrame]:
    """Part and whole vectors by name, for ``build_full_graph``."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    i = F.col("vec_id")
    pre = table(spark, sf, "embeddings").select(
        F.floor(i / (LAYERS * TOKENS)).alias("graph_id"), (F.floor(i / TOKENS) % LAYERS).cast("int").alias("layer"), (i % TOKENS).cast("int").alias("pos"), v.alias("vec"))
    reach_of = F.explode(F.sequence(F.col("pos"), F.lit(TOKENS - 1)))
    heads = F.explode(F.sequence(F.lit(0), F.lit(HEADS - 1)))
    sent = pre.select("graph_id", "layer", F.col("pos").alias("key_pos"), reach_of.alias("pos"), "vec").join(pre.select("graph_id", "layer", "pos"), ["graph_id", "layer", "pos"])
    weight = (F.col("head") + 1) / (2 * (1 + F.col("pos") - F.col("key_pos")))
    attn = sent.withColumn("head", heads).select("graph_id", "layer", "pos", "key_pos", "head", F.transform("vec", lambda x: x * weight).alias("vec"))
    place = ["graph_id", "layer", "pos"]
    moved = vector_sum(attn.select(*place, "vec").unionByName(pre), place, "vec", "vec")
    half = F.transform("vec", lambda x: F.greatest(x, F.lit(0.0)) * 0.5)
    mlp = (pre if parallel else moved).select(*place, half.alias("vec"))
    post = moved.withColumnRenamed("vec", "a").join(mlp.withColumnRenamed("vec", "b"), place).select(*place, F.zip_with("a", "b", lambda x, y: x + y).alias("vec"))
    out = {"attn": attn, "resid_pre": pre, "mlp_out": mlp, "resid_post": post}
    return out if parallel else out | {"resid_mid": moved}


def _vectors_sql(parallel: bool) -> str:
    return f"""
pre AS MATERIALIZED (
  SELECT vec_id // {LAYERS * TOKENS} AS g, vec_id // {TOKENS} % {LAYERS} AS l, vec_id % {TOKENS} AS p, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings
),
attn AS MATERIALIZED (
  SELECT t.g, t.l, t.p, k.p AS q, h.head, list_transform(k.vec, lambda x: x * ((h.head + 1) / (2 * (1 + t.p - k.p))::DOUBLE)) AS vec
  FROM pre t JOIN pre k ON k.g = t.g AND k.l = t.l AND k.p <= t.p JOIN (SELECT unnest(generate_series(0, {HEADS - 1})) AS head) h ON true
),
mid AS MATERIALIZED (
  SELECT g, l, p, list(s ORDER BY d) AS vec FROM (
    SELECT g, l, p, d, sum(x) AS s FROM (
      SELECT g, l, p, unnest(generate_series(1, len(vec))) AS d, unnest(vec) AS x FROM (SELECT g, l, p, vec FROM attn UNION ALL SELECT g, l, p, vec FROM pre)
    ) GROUP BY ALL
  ) GROUP BY g, l, p
),
mlp AS MATERIALIZED (SELECT g, l, p, list_transform(vec, lambda x: greatest(x, 0.0) * 0.5) AS vec FROM {'pre' if parallel else 'mid'}),
post AS MATERIALIZED (
  SELECT m.g, m.l, m.p, list_transform(generate_series(1, len(m.vec)), lambda i: m.vec[i] + f.vec[i]) AS vec FROM mid m JOIN mlp f USING (g, l, p)
)"""


def _shares_sql(name: str, parts: list[str], whole: str, threshold: float | None = None) -> str:
    """CTE ``name(g, l, p, kind, q, head, share)`` of the parts (selects of g, l, p, kind, q, head, vec)."""
    share = "d / sum(d) OVER (PARTITION BY g, l, p)"
    kept = f"{name}_raw" if threshold is not None else name
    out = f"""
{kept} AS (
  SELECT g, l, p, kind, q, head, {share} AS share FROM (
    SELECT x.g, x.l, x.p, x.kind, x.q, x.head,
           greatest(list_sum(list_transform(w.vec, lambda v: abs(v))) - list_sum(list_transform(generate_series(1, len(w.vec)), lambda i: abs(x.vec[i] - w.vec[i] + 1e-6))), 1e-5) AS d
    FROM ({' UNION ALL '.join(parts)}) x JOIN {whole} w ON w.g = x.g AND w.l = x.l AND w.p = x.p
  )
)"""
    if threshold is not None:
        out += f""",
{name} AS (
  SELECT g, l, p, kind, q, head, k / nullif(sum(k) OVER (PARTITION BY g, l, p), 0) AS share
  FROM (SELECT *, CASE WHEN share > {threshold} THEN share ELSE 0.0 END AS k FROM {name}_raw)
)"""
    return out


_ATTN = "SELECT g, l, p, 'attn' AS kind, q, head, vec FROM attn"


def _one(kind: str, source: str) -> str:
    return f"SELECT g, l, p, '{kind}', NULL, NULL, vec FROM {source}"


def _full_graph_sql(parallel: bool, threshold: float | None = None) -> str:
    if parallel:
        shares = _shares_sql("first", [_ATTN, _one("mlp", "mlp"), _one("residual", "pre")], "post", threshold) + ", second AS (SELECT * FROM first)"
    else:
        shares = _shares_sql("first", [_ATTN, _one("residual", "pre")], "mid", threshold) + "," + _shares_sql(
            "second", ["SELECT g, l, p, 'mlp' AS kind, NULL AS q, NULL AS head, vec FROM mlp", _one("residual", "mid")], "post", threshold)
    here = "CASE WHEN l = 0 THEN 'X0_' || {0} ELSE 'I' || (l - 1) || '_' || {0} END"
    source = here.format("p") if parallel else "'A' || l || '_' || p"
    more = "UNION ALL SELECT g, 'A' || l || '_' || p, 'I' || l || '_' || p, share FROM first WHERE kind = 'residual'" if parallel else ""
    return f"""WITH {_vectors_sql(parallel)}, {shares},
drawn(graph_id, src, dst, share) AS (
  SELECT g, {here.format('q')}, 'A' || l || '_' || p, share FROM first WHERE kind = 'attn'
  UNION ALL SELECT g, {here.format('p')}, 'A' || l || '_' || p, share FROM first WHERE kind = 'residual'
  {more}
  UNION ALL SELECT g, {source}, 'M' || l || '_' || p, share FROM second WHERE kind = 'mlp'
  UNION ALL SELECT g, 'M' || l || '_' || p, 'I' || l || '_' || p, share FROM second WHERE kind = 'mlp'
  UNION ALL SELECT g, {source}, 'I' || l || '_' || p, share FROM second WHERE kind = 'residual'
)
SELECT graph_id, src, dst, round(sum(share), 6) AS weight FROM drawn GROUP BY graph_id, src, dst"""


@register("full_graph", "O81 O83 O85 O93", _full_graph_sql(False))
def full_graph_q(spark: SparkSession, sf: str) -> DataFrame:
    return _edge_out(build_full_graph(**flow_vectors(spark, sf, False)))


@register("full_graph_parallel", "O81 O84 O93", _full_graph_sql(True))
def full_graph_parallel_q(spark: SparkSession, sf: str) -> DataFrame:
    return _edge_out(build_full_graph(**flow_vectors(spark, sf, True)))


@register("full_graph_threshold", "O81 O87 O93", _full_graph_sql(False, THRESHOLD))
def full_graph_threshold_q(spark: SparkSession, sf: str) -> DataFrame:
    return _edge_out(build_full_graph(**flow_vectors(spark, sf, False), threshold=THRESHOLD))


@register("full_graph_parallel_threshold", "O81 O88 O93", _full_graph_sql(True, THRESHOLD))
def full_graph_parallel_threshold_q(spark: SparkSession, sf: str) -> DataFrame:
    return _edge_out(build_full_graph(**flow_vectors(spark, sf, True), threshold=THRESHOLD))


def _share_out(s: DataFrame) -> DataFrame:
    return s.select("graph_id", "layer", "pos", "kind", "key_pos", "head", F.round("share", 6).alias("share"))


_SHARE_SQL = "SELECT g AS graph_id, l::INT AS layer, p::INT AS pos, kind, q::INT AS key_pos, head::INT AS head, round(share, 6) AS share FROM first"


@register("attention_shares", "O83", f"WITH {_vectors_sql(False)}, {_shares_sql('first', [_ATTN, _one('residual', 'pre')], 'mid')} {_SHARE_SQL}")
def attention_shares_q(spark: SparkSession, sf: str) -> DataFrame:
    v = flow_vectors(spark, sf, False)
    return _share_out(attention_contributions(v["attn"], v["resid_pre"], v["resid_mid"]))


_MLP = "SELECT g, l, p, 'mlp' AS kind, NULL AS q, NULL AS head, vec FROM mlp"


@register("mlp_shares", "O85", f"WITH {_vectors_sql(False)}, {_shares_sql('first', [_MLP, _one('residual', 'mid')], 'post')} {_SHARE_SQL}")
def mlp_shares_q(spark: SparkSession, sf: str) -> DataFrame:
    v = flow_vectors(spark, sf, False)
    return _share_out(mlp_contributions(v["mlp_out"], v["resid_mid"], v["resid_post"]))


_PIECES = f"""SELECT g, l, p, 'component' AS kind, NULL AS q, c AS head, list_transform(generate_series(1, len(vec)), lambda i: CASE WHEN (i - 1) % {COMPONENTS} = c THEN vec[i] ELSE 0.0 END) AS vec
FROM mlp, (SELECT unnest(generate_series(0, {COMPONENTS - 1})) AS c)"""


@register("component_shares", "O86", f"WITH {_vectors_sql(False)}, {_shares_sql('first', [_PIECES, _one('residual', 'mid')], 'post')} {_SHARE_SQL}")
def component_shares_q(spark: SparkSession, sf: str) -> DataFrame:
    """Component c of the feed-forward block: its dimensions of remainder c."""
    v = flow_vectors(spark, sf, False)
    pieces = v["mlp_out"].withColumn("component", F.explode(F.sequence(F.lit(0), F.lit(COMPONENTS - 1)))).withColumn(
        "vec", F.transform("vec", lambda x, i: F.when(i % COMPONENTS == F.col("component"), x).otherwise(0.0)))
    return _share_out(component_contributions(pieces, v["resid_mid"], v["resid_post"]))


def _targets(sizes: DataFrame, token_col=None) -> DataFrame:
    last_layer = F.col("n_layers") - 1
    tok = (F.col("n_tokens") - 1) if token_col is None else token_col
    return sizes.select("graph_id", F.concat(F.lit("I"), last_layer.cast("string"), F.lit("_"), tok.cast("string")).alias("node"),
                        level("I", last_layer).alias("level"))


def _sources(sizes: DataFrame) -> DataFrame:
    return sizes.select("graph_id", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 1)).alias("token"))


def best_paths(spark: SparkSession, sf: str, threshold: float = THRESHOLD) -> DataFrame:
    sizes, e = edges(spark, sf, False)
    best = best_to_target(e, _targets(sizes), threshold)
    src = _sources(sizes).withColumn("node", F.concat(F.lit("X0_"), F.col("token").cast("string")))
    return src.join(best, ["graph_id", "node"], "left").select(
        "graph_id", "token", F.coalesce("score", F.lit(0.0)).alias("weight"), F.coalesce("path", F.lit("")).alias("path"))


def _dp_sql(threshold: float) -> str:
    # Levels: X0 = 0 ... I_{L-1} = 3L; the DP runs from 3L - 1 down to 0.
    parts = [f"""{_edges_sql(False)},
fe AS (SELECT * FROM edges WHERE weight > {threshold}),
b_top AS (
  SELECT graph_id, 'I' || ((SELECT nl FROM sz) - 1) || '_' || ((SELECT nt FROM sz) - 1) AS node, 0.0::DOUBLE AS score,
         'I' || ((SELECT nl FROM sz) - 1) || '_' || ((SELECT nt FROM sz) - 1) AS path
  FROM graphs
)"""]
    prev = "b_top"
    for lvl in range(3 * 4 - 1, -1, -1):
        parts.append(f"""
b{lvl} AS (
  SELECT * FROM {prev}
  UNION ALL
  SELECT graph_id, node, score, path FROM (
    SELECT e.graph_id, e.src AS node, e.weight + b.score AS score, e.src || ',' || b.path AS path,
           row_number() OVER (PARTITION BY e.graph_id, e.src ORDER BY e.weight + b.score DESC, e.src || ',' || b.path) AS rn
    FROM fe e JOIN {prev} b ON b.graph_id = e.graph_id AND b.node = e.dst
    WHERE e.src_level = {lvl}
  ) WHERE rn = 1
)""")
        prev = f"b{lvl}"
    parts.append(f"""
srcs AS (SELECT graph_id, token FROM grid WHERE layer = 0),
bp AS (
  SELECT s.graph_id, s.token, coalesce(b.score, 0.0) AS weight, coalesce(b.path, '') AS path
  FROM srcs s LEFT JOIN {prev} b ON b.graph_id = s.graph_id AND b.node = 'X0_' || s.token
)""")
    return ",".join(parts)


@register(
    "best_path",
    "O96",
    f"WITH {_dp_sql(THRESHOLD)} SELECT graph_id, token, round(weight, 6) AS weight, path FROM bp",
)
def best_path_q(spark: SparkSession, sf: str) -> DataFrame:
    bp = best_paths(spark, sf)
    return bp.select("graph_id", "token", F.round("weight", 6).alias("weight"), "path")


@register(
    "best_tokens",
    "O98",
    f"WITH {_dp_sql(THRESHOLD)} SELECT graph_id, token, round(weight, 6) AS weight, "
    "row_number() OVER (PARTITION BY graph_id ORDER BY weight DESC, token) AS rank FROM bp",
)
def best_tokens_q(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    bp = best_paths(spark, sf)
    # Per graph: n_tokens rows, a bounded window.
    w = Window.partitionBy("graph_id").orderBy(F.col("weight").desc(), F.col("token"))
    return bp.select("graph_id", "token", F.round("weight", 6).alias("weight"), F.row_number().over(w).alias("rank"))


@register(
    "relevant_nodes",
    "O95",
    f"""WITH RECURSIVE {_edges_sql(False)},
fe AS (SELECT * FROM edges WHERE weight > {THRESHOLD}),
srcs AS (SELECT graph_id, token FROM grid WHERE layer = 0),
fwd(graph_id, start, node) AS (
  SELECT graph_id, token, 'X0_' || token FROM srcs
  UNION SELECT f.graph_id, f.start, e.dst FROM fwd f JOIN fe e ON e.graph_id = f.graph_id AND e.src = f.node
),
bwd(graph_id, node) AS (
  SELECT graph_id, 'I' || ((SELECT nl FROM sz) - 1) || '_' || ((SELECT nt FROM sz) - 1) FROM graphs
  UNION SELECT b.graph_id, e.src FROM bwd b JOIN fe e ON e.graph_id = b.graph_id AND e.dst = b.node
)
SELECT s.graph_id, s.token, count(b.node) AS n_nodes
FROM srcs s LEFT JOIN fwd f ON f.graph_id = s.graph_id AND f.start = s.token
LEFT JOIN bwd b ON b.graph_id = f.graph_id AND b.node = f.node
GROUP BY ALL""",
)
def relevant_nodes_q(spark: SparkSession, sf: str) -> DataFrame:
    sizes, e = edges(spark, sf, False)
    src = _sources(sizes).select("graph_id", F.col("token").alias("start"),
                                 F.concat(F.lit("X0_"), F.col("token").cast("string")).alias("node"), F.lit(0).alias("level"))
    fwd = reach(e, src, True, THRESHOLD)
    tgt = _targets(sizes).withColumn("start", F.lit(0))
    bwd = reach(e, tgt.select("graph_id", "start", "node", "level"), False, THRESHOLD).select("graph_id", "node")
    rel = fwd.join(bwd, ["graph_id", "node"])
    counts = rel.groupBy("graph_id", "start").agg(F.count(F.lit(1)).alias("n_nodes"))
    return src.select("graph_id", F.col("start").alias("token")).join(
        counts.withColumnRenamed("start", "token"), ["graph_id", "token"], "left"
    ).select("graph_id", "token", F.coalesce("n_nodes", F.lit(0)).cast("long").alias("n_nodes"))


@register(
    "paths_to_outputs",
    "O97",
    f"""WITH RECURSIVE {_edges_sql(False)},
fe AS (SELECT * FROM edges WHERE weight > {THRESHOLD}),
outs AS (SELECT graph_id, token FROM grid WHERE layer = (SELECT nl FROM sz) - 1),
anc(graph_id, out_tok, node) AS (
  SELECT graph_id, token, 'I' || ((SELECT nl FROM sz) - 1) || '_' || token FROM outs
  UNION SELECT a.graph_id, a.out_tok, e.src FROM anc a JOIN fe e ON e.graph_id = a.graph_id AND e.dst = a.node
)
SELECT a.graph_id, a.out_tok AS token, count(*) AS n_edges
FROM anc a JOIN fe e ON e.graph_id = a.graph_id AND e.dst = a.node GROUP BY ALL""",
)
def paths_to_outputs_q(spark: SparkSession, sf: str) -> DataFrame:
    sizes, e = edges(spark, sf, False)
    outs = _sources(sizes)
    tgt = outs.join(sizes, "graph_id").select(
        "graph_id", F.col("token").alias("start"),
        F.concat(F.lit("I"), (F.col("n_layers") - 1).cast("string"), F.lit("_"), F.col("token").cast("string")).alias("node"),
        level("I", F.col("n_layers") - 1).alias("level"))
    anc = reach(e, tgt, False, THRESHOLD)
    fe = edges_above(e, THRESHOLD).select("graph_id", F.col("dst").alias("node"))
    return anc.join(fe, ["graph_id", "node"]).groupBy("graph_id", F.col("start").alias("token")).agg(
        F.count(F.lit(1)).alias("n_edges"))
