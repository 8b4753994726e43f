"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "souk", checkpoint_dir: str | None = None) -> SparkSession:
    """Return (or create) a session configured the way every operator expects.

    UTC session time zone (date arithmetic must not depend on the host), AQE on
    (runtime coalescing, broadcast switch and skew-join splitting), UI off.
    ``checkpoint_dir`` names the shared folder where the session names none itself.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app_name)
        .master(master or f"local[{cpus}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # delete reliable checkpoint files once their DataFrame is garbage collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    )
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.sparkContext.setLogLevel("ERROR")
    if checkpoint_dir and not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", checkpoint_dir)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stored tables, from ``spark.checkpoint.dir``.

    It is never invented here: a machine-local folder would lose data on a cluster.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(configured)
    return configured


TASK_ROWS = 500_000       # rows that one task sorts or groups, about


def tasks_for(df: DataFrame, rows: int) -> int:
    """Partitions for a shuffle of ``rows`` rows: one for each ``TASK_ROWS``, so a task's memory
    stays the same as tables grow, and no fewer than the session runs at once."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` rows in parts of about ``TASK_ROWS``: what a task that reads files holds
    grows with its split of them, what a task of such a part holds does not. Rows are dealt by
    all their values and the task that read them, so only equal rows of one task stay together."""
    if rows <= TASK_ROWS:
        return df
    return df.withColumn("__reader", F.spark_partition_id()) \
        .repartition(tasks_for(df, rows), *df.columns, "__reader").drop("__reader")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/souk-scratch/{name}-{uuid.uuid4().hex}"


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the re-read table: lineage is
    cut, and later passes read only the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
