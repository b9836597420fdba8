"""The stateless rules run unchanged on a stream: classify (text, completion) rows as they arrive.

``readStream`` -> cheap pattern rule column -> any sink. The skeleton UDF and all joins or
iterative operators are batch-only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filtering import cheap_rule

PAIR_ROWS = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("completion", T.StringType()),
])


def stream_pairs(spark: SparkSession, path: str, schema: T.StructType = PAIR_ROWS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def classify_stream(pairs: DataFrame) -> DataFrame:
    """Adds ``rule`` (first matching JVM rule, NULL = keep) to a streaming DataFrame."""
    return pairs.withColumn("rule", cheap_rule(F.col("text"), F.col("completion")))
