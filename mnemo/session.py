"""Session helpers: building a session, the shared checkpoint folder, scratch tables."""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "mnemo") -> SparkSession:
    """Session for tests and benches. On a cluster, pass the session you already have instead."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MNEMO_DRIVER_MEMORY", "16g"))
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster names it in ``spark.checkpoint.dir``; we only pick our own folder when
    nothing is set (local tests), never override a configured one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        configured = tempfile.mkdtemp(prefix="mnemo-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written intermediate tables."""
    import uuid

    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/mnemo-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss, unlike a local one).

    The input is cached first: writing the checkpoint otherwise recomputes the whole plan a
    second time after the eager count.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df.persist()
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back: cuts lineage, survives lost executors,
    and gives what reads it several times sizes to plan with."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """``df`` written once under the shared folder (or to ``path``) in buckets of ``key``: joins on it move only their other side.

    ``df`` should already be dealt by ``key`` over as many parts (``spark.sql.shuffle.partitions`` unless given), so that every task
    writes one bucket.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(_table_of(path))
    return spark.table(_table_of(path))


def bucketed_at(spark: SparkSession, path: str, schema: StructType, key: str, buckets: int) -> DataFrame:
    """What ``bucketed`` wrote to ``path``, in this session or one before."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    said = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_table_of(path)} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{said}'")
    return spark.table(_table_of(path))


def _table_of(path: str) -> str:
    return f"mnemo_{hashlib.sha256(path.encode()).hexdigest()[:20]}"


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over the cluster only when its scan yields too few partitions.

    A small parquet file is one split, so CPU-heavy per-row work (tokenizing, n-grams) would
    run in one task. Large inputs already split into many partitions and pass unchanged.
    """
    sc = df.sparkSession.sparkContext
    target = min_partitions or 2 * sc.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
