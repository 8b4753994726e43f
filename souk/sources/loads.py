"""Tables that grow by numbered loads, and identity keys that stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.operators.ranks import global_row_number


class Loads:
    """Parquet tables below ``path`` (a folder that all executors share), one partition per load.

    A load counts once ``finish`` has written its mark; one that broke off leaves files that
    nobody reads and the next attempt overwrites.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def last_load(self) -> int:
        """Number of the last complete load (0: none)."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n.removeprefix("load=")) for n in names if n.startswith("load=")), default=0)

    def write(self, df: DataFrame, table: str, load: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/load={load}")

    def read(self, table: str, until: int) -> DataFrame:
        """Rows of all loads up to ``until``, with their ``load``."""
        return self.spark.read.parquet(f"{self.path}/{table}").where(F.col("load") <= until)

    def finish(self, load: int) -> int:
        self.write(self.spark.range(1), "done", load)
        return load


class IdentityKeys(Loads):
    """Whole-number keys as an identity column gives them: a natural key keeps its number for
    ever, new ones are numbered behind the greatest so far, without gaps.

    Only the new natural keys are ordered, range by range; known ones are found by an anti-join.
    """

    def assign(self, df: DataFrame, natural: Sequence[str], name: str = "surrogate_key",
               buckets: int | None = None) -> DataFrame:
        """``df`` with ``name``; rows with equal natural keys (NULL parts are equal) share one."""
        n = self.last_load() + 1
        keys = df.select(*natural).distinct()
        start = 0
        if n > 1:
            known = self.read("keys", n - 1)
            start = known.agg(F.max("__key")).first()[0] or 0
            keys = keys.join(known, self._same(keys, known, natural), "left_anti")
        fresh = global_row_number(keys, [(c, True) for c in natural], rn="__rn", total="__n", buckets=buckets)
        self.write(fresh.select(*natural, (F.col("__rn") + start).alias("__key")), "keys", n)
        self.finish(n)
        numbers = self.read("keys", n).select(*[F.col(c).alias(f"__of_{c}") for c in natural], F.col("__key").alias(name))
        same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in natural]
        return df.join(numbers, same).select(*df.columns, name)

    @staticmethod
    def _same(left: DataFrame, right: DataFrame, natural: Sequence[str]) -> list:
        return [left[c].eqNullSafe(right[c]) for c in natural]
