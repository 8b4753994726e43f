"""Shared helpers: tables in the shared folder, block pairing, components.

Intermediate tables are Parquet written below ``spark.checkpoint.dir`` (a folder
all executors share), so a lost executor never takes a result with it and long
lineages are cut. Nothing here uses a machine-local folder.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; never reused, so frames stay readable."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/souk-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and return the re-read table."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPACE = {str: re.compile(r"[\x20\x09-\x0D]"), bytes: re.compile(rb"[\x20\x09-\x0D]")}


def slices(text, size: int = 1 << 20) -> Iterator:
    """A text in parts of about ``size``, cut at ASCII white space, so words stay whole and
    a very long text never becomes one very long list of words."""
    at, n = 0, len(text)
    while n - at > size:
        cut = SPACE[type(text)].search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


TASKS_PER_CORE = 4


def block_pairs(left: DataFrame, left_key: str, n_left: int,
                right: DataFrame, right_key: str, n_right: int) -> DataFrame:
    """Every (left block row, right block row) pair.

    Both frames hold one row per block (a bounded binary payload). The product is
    over blocks, never over rows; nothing is broadcast, and neither side is copied
    on disk. A task streams the pairs of two partitions; these hold as many blocks as keep
    the number of tasks at a few per core, however many blocks there are.
    """
    spark = left.sparkSession
    tasks = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_left, n_right = max(1, n_left), max(1, n_right)
    few = min(n_left, n_right, max(1, round(tasks ** 0.5)))
    many = min(max(n_left, n_right), -(-tasks // few))
    parts = (few, many) if n_left <= n_right else (many, few)
    lhs = left.repartitionByRange(parts[0], left_key)
    rhs = right.repartitionByRange(parts[1], right_key)
    return lhs.hint("shuffle_replicate_nl").crossJoin(rhs)


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")) \
        .unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counts = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not counts.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).take(1)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an undirected long edge list.

    ``component`` is the smallest node id reachable. Alternating large-star and
    small-star contraction: a logarithmic number of rounds, each two grouped minima
    (combined map-side, so a hub costs one row per task) and equi-joins (a hub's rows are
    split by the adaptive skew join of two stored tables). No adjacency list is ever
    gathered, and nothing but one yes or no per half round reaches the driver.

    Self-loops and repeated edges are ignored; rows with a null end are dropped
    because they name no node.
    """
    e = (edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
         .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
         .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    e = stored(e, "edges")
    while not _is_stars(e):
        # large star: every larger neighbour of u moves to the least id around u
        sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(sym.groupBy("a").agg(F.min("b").alias("m"))
                       .select("a", F.least("a", "m").alias("m")), "least")
        e = stored(sym.join(least, "a").where(F.col("b") > F.col("a"))
                   .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        if _is_stars(e):            # as short chains are by now
            break
        # small star: u and its smaller neighbours move to the least of them
        least = stored(e.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = e.join(least, "a").where(F.col("b") != F.col("m")) \
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    members = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)
