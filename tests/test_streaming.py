import tempfile

from mnemo.streaming.rules import classify_stream, stream_pairs


def test_stream_classifies_like_batch(spark):
    src = tempfile.mkdtemp(prefix="mnemo-stream-src-")
    rows = [(1, "a 1 b 2", "3 4 5"), (2, "plain words here", "other words there"), (3, "....", ". . .")]
    spark.createDataFrame(rows, "row_id long, text string, completion string").write.mode("overwrite").parquet(src)
    q = classify_stream(stream_pairs(spark, src)).writeStream.format("memory").queryName("mnemo_rules").start()
    try:
        q.processAllAvailable()
        got = {r["row_id"]: r["rule"] for r in spark.sql("SELECT row_id, rule FROM mnemo_rules").collect()}
    finally:
        q.stop()
    assert got == {1: "sequential_numbers", 2: None, 3: "repeated_text"}
