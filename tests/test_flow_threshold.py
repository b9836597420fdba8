"""The threshold of a parallel graph: small shares go, the rest sum to 1 per token."""

from pyspark.sql import functions as F

from mnemo.plans.q_flow import shares


def test_parallel_threshold_renormalizes(spark):
    cut = 0.2
    _, attn, resid, ffn, _ = shares(spark, "/root/testdata/sf0.001", parallel=True, threshold=cut)
    _, attn0, resid0, ffn0, _ = shares(spark, "/root/testdata/sf0.001", parallel=True)

    def total(a, r, f):
        token = ["graph_id", "layer", "token"]
        rows = a.select("graph_id", "layer", F.col("to_tok").alias("token"), "share").unionByName(r.select(*token, "share"))
        return rows.unionByName(f.select(*token, "share")).groupBy(*token).agg(F.sum("share").alias("s"), F.max("share").alias("m"))

    before, after = total(attn0, resid0, ffn0), total(attn, resid, ffn)
    j = before.withColumnRenamed("s", "s0").withColumnRenamed("m", "m0").join(after, ["graph_id", "layer", "token"])
    bad = j.where((F.abs(F.col("s0") - 1) > 1e-9) | F.when(F.col("m0") > cut, F.abs(F.col("s") - 1) > 1e-9).otherwise(F.col("s").isNotNull()))
    assert before.count() == after.count() and bad.count() == 0
    assert attn.where((F.col("share") > 0) & (F.col("share") <= cut)).count() == 0
