"""Stored tables laid out for the joins to come: buckets by key, partitions by month."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _name(path: str) -> str:
    return f"souk_{hashlib.md5(path.encode()).hexdigest()}"


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Store ``df`` in ``buckets`` hash buckets of ``key``, each sorted by it, with its layout.

    Tables with equal keys and bucket counts join and group by the key without an exchange.
    One task reads a bucket, so ``buckets`` should be the shuffle partitions of the largest.
    """
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(_name(path)))
    spark = df.sparkSession
    spark.createDataFrame([(key, buckets, df.schema.toDDL())], "key string, buckets int, columns string") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}.layout")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table written by :func:`write_bucketed`, with its buckets, in any session."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        r, quoted = spark.read.parquet(f"{path}.layout").first(), path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({r['columns']}) USING parquet CLUSTERED BY (`{r['key']}`) "
                  f"SORTED BY (`{r['key']}`) INTO {r['buckets']} BUCKETS LOCATION '{quoted}'")
    return spark.table(name)


def write_by_month(df: DataFrame, path: str, datekey: str, order: str) -> None:
    """Store ``df`` partitioned by the month of its ``yyyyMMdd`` key (column ``month_key``).

    Rows are dealt by ranges of (month, ``order``), so a busy month spreads over many tasks and
    a quiet one makes one file.
    """
    (df.withColumn("month_key", F.floor(F.col(datekey) / 100).cast("int"))
     .repartitionByRange("month_key", order).write.mode("overwrite").partitionBy("month_key").parquet(path))


def join_calendar_by_month(facts: DataFrame, cal: DataFrame, datekey: str, columns: tuple[str, ...]) -> DataFrame:
    """Facts stored by :func:`write_by_month` with the days of a filtered calendar.

    The month takes part in the join, so the filter on the calendar prunes the partitions that
    are read when the query runs (dynamic partition pruning). The calendar is bounded by
    construction and broadcast.
    """
    days = cal.select(F.col("datekey").alias(datekey), F.floor(F.col("datekey") / 100).cast("int").alias("month_key"),
                      *columns)
    return facts.join(F.broadcast(days), ["month_key", datekey])
