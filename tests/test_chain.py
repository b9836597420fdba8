"""The application of all stages, job parts, write-once outputs, medians, BLEU's shuffles and graphs from vectors."""

import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemo.operators import pipeline
from mnemo.operators.bleu import sentence_bleu
from mnemo.operators.flow import attention_contributions, build_full_graph, component_contributions, mlp_contributions, parallel_contributions
from mnemo.operators.graph import best_to_target, reach
from mnemo.operators.memorization import score_summary
from mnemo.session import scratch_path
from mnemo.sources.io import materialize_once, read_filtered_ids, read_jsonl_corpus, read_scores, union_job_outputs, write_filtered_ids


def texts(n=30):
    r = random.Random(4)
    base = [" ".join(f"w{r.randint(0, 40)}" for _ in range(14)) for _ in range(6)]
    return [(k, base[k % 6] if k % 3 else " ".join(f"w{r.randint(0, 40)}" for _ in range(14))) for k in range(n)] + [(99, "w1"), (98, None)]


PARAMS = {"prompt_tokens": 6, "generation_tokens": 5, "k": 2}


def test_a_stopped_run_goes_on_where_it_was(spark, monkeypatch):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").cache()
    train = docs.where("doc_id % 3 > 0")
    folder = scratch_path(spark, "chain")

    def run(**more):
        return pipeline.run_pipeline(spark, ("docs 1", docs), ("train 1", train), folder, **PARAMS, **more)

    def stopped(tables, params):
        raise RuntimeError("killed")

    whole = pipeline.stages()
    killed = [s if s.name != "pairs" else pipeline.Stage("pairs", stopped, s.needs, s.params) for s in whole]
    monkeypatch.setattr(pipeline, "stages", lambda: killed)
    with pytest.raises(RuntimeError, match="killed"):
        run()
    monkeypatch.setattr(pipeline, "stages", lambda: whole)
    second = run()
    assert second.built == ["pairs", "evaluation"]
    rows = sorted(map(tuple, second.tables["evaluation"].collect()))
    third = run()
    assert third.built == [] and sorted(map(tuple, third.tables["evaluation"].collect())) == rows and rows
    assert run(drop=0.9).built == ["pairs", "evaluation"]  # another parameter, only what depends on it
    assert run(mode="dataset").built == ["pairs", "evaluation"]
    assert pipeline.run_pipeline(spark, ("docs 2", docs), ("train 1", train), folder, **PARAMS).built == ["scores", "pairs", "evaluation"]
    with pytest.raises(ValueError):
        run(mode="other")
    with pytest.raises(ValueError):
        run(treshold=1)


def test_unfinished_outputs_are_written_anew(spark):
    path = scratch_path(spark, "once")
    spark.range(3).write.parquet(path)  # data without its note: a run that was stopped
    calls = []

    def build(n=7):
        calls.append(n)
        return spark.range(n)

    assert materialize_once(spark, path, build).count() == 7
    assert materialize_once(spark, path, build).count() == 7 and calls == [7]
    empty = scratch_path(spark, "empty")
    none = materialize_once(spark, empty, lambda: spark.createDataFrame([], "a int, b string"))
    assert none.columns == ["a", "b"] and none.count() == 0 and materialize_once(spark, empty, lambda: 1 / 0).count() == 0


def test_parts(spark):
    schema = T.StructType([T.StructField("x", T.LongType())])
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "part string")
    root = scratch_path(spark, "none")
    assert sorted((r.part, r.status) for r in union_job_outputs(spark, root, expected, schema).collect()) == [("a", "missing"), ("b", "missing"), ("c", "missing")]
    spark.range(2).toDF("x").write.parquet(f"{root}/a")
    spark.range(0).toDF("x").write.parquet(f"{root}/c")
    spark.range(1).toDF("x").write.parquet(f"{root}/d")
    rows = sorted(((r.part, r.x, r.status) for r in union_job_outputs(spark, root, expected, schema).collect()), key=str)
    assert rows == [("a", 0, "found"), ("a", 1, "found"), ("b", None, "missing"), ("c", None, "empty"), ("d", 0, "unexpected")]


def test_corpus_files_of_any_name(spark):
    root = scratch_path(spark, "corpus")
    for name in ("one.jsonl", "two.json", "three.txt"):
        spark.createDataFrame([(1, name)], "doc_id long, text string").coalesce(1).write.json(f"{root}/{name}")
    assert read_jsonl_corpus(spark, f"{root}/three.txt").count() == 1
    with pytest.raises(ValueError):
        read_scores(spark, "scores.csv")
    ids = scratch_path(spark, "ids")
    write_filtered_ids(spark.createDataFrame([("4",), ("9",)], "row_id string").coalesce(1), ids)
    assert [r.value for r in spark.read.text(ids).collect()] == ["Filtered row IDs:", "4", "9"]
    assert sorted(r.row_id for r in read_filtered_ids(spark, ids).collect()) == ["4", "9"]


@pytest.mark.parametrize("n", [1, 2, 501, 2000])
def test_median_of_one_group_of_all_rows(spark, n):
    r = random.Random(n)
    values = [round(r.random(), 3) for _ in range(n)]
    rows = [("g", v) for v in values] + [("g", None), (None, 0.5), (None, 0.25), ("none", None)]
    df = spark.createDataFrame(rows, "grp string, memorization_score double").repartition(4)
    got = {x.grp: (x.n, x.mean_score, x.median_score) for x in score_summary(df, ["grp"]).collect()}
    assert got["g"] == (n + 1, pytest.approx(statistics.mean(values)), pytest.approx(statistics.median(values)))
    assert got[None] == (2, 0.375, 0.375) and got["none"] == (1, None, None)
    whole = score_summary(df).first()
    known = [v for _, v in rows if v is not None]
    assert (whole.n, whole.median_score) == (len(rows), pytest.approx(statistics.median(known)))
    assert score_summary(df.where("false"), ["grp"]).count() == 0


def test_bleu_shuffles_samples_once(spark):
    hyps = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["q"])], "id long, hyp array<string>")
    refs = spark.createDataFrame([(1, ["a", "b"]), (1, ["b"]), (2, []), (4, ["x"])], "id long, ref array<string>")
    out = sentence_bleu(hyps, refs, "id", "hyp", "ref", 2, smooth=True)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.id: r.bleu for r in out.collect()} == {1: pytest.approx(1.0), 2: None}


def vectors(spark, n_graphs=3, layers=2, tokens=3, heads=2, d=5, seed=0):
    r = random.Random(seed)
    vec = lambda: [r.uniform(-1, 1) for _ in range(d)]
    add = lambda *vs: [sum(x) for x in zip(*vs)]
    out = {k: [] for k in ("attn", "resid_pre", "resid_mid", "mlp_out", "resid_post")}
    for g in range(n_graphs):
        for layer in range(layers):
            for p in range(tokens):
                parts = {(q, h): vec() for q in range(p + 1) for h in range(heads)}
                pre, mlp = vec(), vec()
                mid = add(pre, *parts.values())
                out["attn"] += [(g, layer, p, q, h, v) for (q, h), v in parts.items()]
                for name, v in (("resid_pre", pre), ("resid_mid", mid), ("mlp_out", mlp), ("resid_post", add(mid, mlp))):
                    out[name].append((g, layer, p, v))
    place = "graph_id long, layer int, pos int"
    frames = {k: spark.createDataFrame(v, f"{place}, vec array<double>" if k != "attn" else f"{place}, key_pos int, head int, vec array<double>").cache() for k, v in out.items()}
    return out, frames


def share(parts, whole):
    d = [max(sum(map(abs, whole)) - sum(abs(a - b + 1e-6) for a, b in zip(v, whole)), 1e-5) for v in parts]
    return [x / sum(d) for x in d]


def test_shares_of_every_kind(spark):
    raw, f = vectors(spark)
    at = lambda name: {tuple(r[:3]): r[3] for r in raw[name]}
    pre, mid, mlp, post = at("resid_pre"), at("resid_mid"), at("mlp_out"), at("resid_post")
    attn = attention_contributions(f["attn"], f["resid_pre"], f["resid_mid"]).collect()
    place = (1, 1, 2)
    own = [r for r in raw["attn"] if r[:3] == place]
    want = dict(zip([(r[3], r[4]) for r in own] + [(None, None)], share([r[5] for r in own] + [pre[place]], mid[place])))
    assert {(r.key_pos, r.head): r.share for r in attn if (r.graph_id, r.layer, r.pos) == place} == pytest.approx(want)
    block = {r.kind: r.share for r in mlp_contributions(f["mlp_out"], f["resid_mid"], f["resid_post"]).collect() if (r.graph_id, r.layer, r.pos) == place}
    assert [block["mlp"], block["residual"]] == pytest.approx(share([mlp[place], mid[place]], post[place]))
    pieces = f["mlp_out"].withColumn("component", F.explode(F.array(*[F.lit(k) for k in range(5)]))).withColumn(
        "vec", F.transform("vec", lambda x, i: F.when(i == F.col("component"), x).otherwise(0.0)))
    got = {r.head: r.share for r in component_contributions(pieces, f["resid_mid"], f["resid_post"]).collect() if (r.graph_id, r.layer, r.pos) == place}
    split = [[x if i == k else 0.0 for i, x in enumerate(mlp[place])] for k in range(5)]
    assert [got[k] for k in (0, 1, 2, 3, 4, None)] == pytest.approx(share([*split, mid[place]], post[place]))
    for shares in (attention_contributions(f["attn"], f["resid_pre"], f["resid_mid"], threshold=0.05),
                   parallel_contributions(f["attn"], f["mlp_out"], f["resid_pre"], f["resid_post"], threshold=0.05)):
        sums = shares.groupBy("graph_id", "layer", "pos").agg(F.sum("share").alias("s"), F.min(F.when(F.col("share") > 0, F.col("share"))).alias("least")).collect()
        assert all(r.s == pytest.approx(1.0) and r.least > 0.05 for r in sums) and len(sums) == 18


def test_full_graphs_take_in_one_share_a_node(spark):
    _, f = vectors(spark)
    for edges in (build_full_graph(f["attn"], f["resid_pre"], f["mlp_out"], f["resid_post"], f["resid_mid"]),
                  build_full_graph(f["attn"], f["resid_pre"], f["mlp_out"], f["resid_post"], f["resid_mid"], threshold=0.1)):
        into = {(r.graph_id, r.dst): r.w for r in edges.groupBy("graph_id", "dst").agg(F.sum("weight").alias("w")).collect()}
        assert len(into) == 3 * 2 * 3 * 3 and all(w == pytest.approx(1.0) for (_, n), w in into.items() if n[0] in "AI")
    parallel = build_full_graph(f["attn"], f["resid_pre"], f["mlp_out"], f["resid_post"])
    assert parallel.where("src like 'A%' and dst like 'M%'").count() == 0 and parallel.where("dst like 'M%'").count() == 18


def random_graph(n_levels, width, seed):
    r = random.Random(seed)
    nodes = [(f"n{lvl}_{k}", lvl) for lvl in range(n_levels) for k in range(width)]
    return [(g, a, b, la, lb, round(r.uniform(0, 1), 3)) for g in range(2) for a, la in nodes for b, lb in nodes if la < lb and r.random() < 0.3]


def test_paths_equal_enumeration_and_plans_stay_flat(spark):
    schema = "graph_id long, src string, dst string, src_level int, dst_level int, weight double"
    lines = []
    for levels in (3, 7):
        rows = random_graph(levels, 3, levels)
        edges = spark.createDataFrame(rows, schema).cache()
        last = f"n{levels - 1}_0"
        targets = spark.createDataFrame([(g, last, levels - 1) for g in range(2)], "graph_id long, node string, level int")
        best = best_to_target(edges, targets, 0.2)
        lines.append(len(best._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        out = {}
        for g in range(2):
            kept = [(a, b, w) for gg, a, b, _, _, w in rows if gg == g and w > 0.2]

            def heaviest(node):
                if node == last:
                    return 0.0
                return max((w + h for a, b, w in kept if a == node and (h := heaviest(b)) is not None), default=None)

            out |= {(g, a): heaviest(a) for a in {x for e in kept for x in e[:2]} | {last}}
        assert {(r.graph_id, r.node): r.score for r in best.collect()} == pytest.approx({k: v for k, v in out.items() if v is not None})
        starts = spark.createDataFrame([(g, 0, "n0_0", 0) for g in range(2)], "graph_id long, start int, node string, level int")
        got = {(r.graph_id, r.node) for r in reach(edges, starts, True, 0.2).collect()}
        want = {(g, "n0_0") for g in range(2)}
        for _ in range(levels):
            want |= {(g, b) for g, a, b, _, _, w in rows if (g, a) in want and w > 0.2}
        assert got == want
        back = spark.createDataFrame([(g, 0, last, levels - 1) for g in range(2)], "graph_id long, start int, node string, level int")
        assert {(r.graph_id, r.node) for r in reach(edges, back, False, 0.2).collect()} == {k for k, v in out.items() if v is not None}
    assert lines[0] == lines[1]
