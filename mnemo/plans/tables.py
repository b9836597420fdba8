"""Loading the input tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


# Tables whose rows carry CPU-heavy work (long texts, vectors): spread small scans over the cores.
HEAVY = {"documents", "pages", "conversations", "embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str, light: bool = False) -> DataFrame:
    """A table of the folder. ``light``: the reader takes little of each row, so that not even a small scan is spread."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in HEAVY and not light else df
