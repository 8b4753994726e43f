"""Distributed replacements for windows that have no PARTITION BY.

``ntile``/``rank``/``percent_rank``/``row_number`` over a whole table, or ``lag`` inside
a group that may hold a third of all rows, make Spark move the data to a single task.
The operators here keep the exact SQL semantics but spread the work:

1. *Ranges.* ``repartitionByRange`` on the full sort key deals the rows into
   contiguous ranges, as many as the session's shuffle partitions (or ``buckets``).
   Every sort column takes part, so one heavy value spreads over many ranges. The
   partition id is stored with the rows in the shared checkpoint folder, which makes
   it a fact that recomputing a lost task cannot change.
2. *Local work.* Windows run with ``partitionBy(range)``.
3. *Stitching.* One summary row per range gives row offsets, totals and the rows that
   open and close it. Those few rows are joined back on the range id.

There is no cap on the number of ranges and no other path for small inputs.

The sort key must be a total order (end it with a unique key), as in the
reference's ranking windows once ties are broken deliberately.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.session import ensure_checkpoint_dir

OrderSpec = Sequence[tuple[str, bool]]  # (column, ascending)
BUCKET = "__bucket"


def _order_cols(order: OrderSpec) -> list[Column]:
    # Spark default null order: ascending NULLS FIRST, descending NULLS LAST.
    return [F.col(n).asc() if a else F.col(n).desc() for n, a in order]


def bucketize(df: DataFrame, order: OrderSpec, buckets: int | None = None) -> DataFrame:
    """``df`` with ``__bucket``, the number of its contiguous range of ``order``; stored."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(spark)
    ranged = df.repartitionByRange(n, *_order_cols(order)).withColumn(BUCKET, F.spark_partition_id())
    return ranged.checkpoint(eager=True)


def _offsets(counts: DataFrame) -> list[Column]:
    """Columns over one row per range with ``__cnt``: rows before it and the grand total."""
    w = Window.orderBy(BUCKET)  # one row per range
    before = F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("__cnt").over(Window.partitionBy(F.lit(1)))
    return [F.coalesce(before, F.lit(0)).alias("__offset"), total.alias("__n")]


def global_row_number(df: DataFrame, order: OrderSpec, rn: str = "row_number", total: str = "__n",
                      buckets: int | None = None) -> DataFrame:
    """``row_number() over (order by ...)`` without a single-partition window.

    Adds ``rn`` (1-based) and ``total`` (row count of ``df``).
    """
    bucketed = bucketize(df, order, buckets)
    counts = bucketed.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("__cnt"))
    offsets = counts.select(BUCKET, *_offsets(counts))
    local = F.row_number().over(Window.partitionBy(BUCKET).orderBy(*_order_cols(order)))
    return (bucketed.withColumn("__local", local).join(offsets, BUCKET)
            .withColumn(rn, F.col("__offset") + F.col("__local"))
            .withColumnRenamed("__n", total).drop(BUCKET, "__local", "__offset"))


def ntile_of(rn: Column, n: Column, tiles: int) -> Column:
    """SQL ``ntile(tiles)`` from a 1-based row number and the row count.

    The first ``n mod tiles`` tiles hold one extra row, as in the SQL standard.
    """
    q = F.floor(n / F.lit(tiles)).cast("long")
    r = (n - q * tiles).cast("long")
    big = r * (q + 1)
    first = F.floor((rn - 1) / (q + 1)) + 1
    rest = r + F.floor((rn - 1 - big) / F.greatest(q, F.lit(1))) + 1
    return F.when(rn <= big, first).otherwise(rest).cast("int")


def global_ntile(df: DataFrame, order: OrderSpec, tiles: int, out: str,
                 buckets: int | None = None) -> DataFrame:
    """``ntile(tiles) over (order by ...)`` computed range by range."""
    numbered = global_row_number(df, order, rn="__grn", total="__gn", buckets=buckets)
    return numbered.withColumn(out, ntile_of(F.col("__grn"), F.col("__gn"), tiles)).drop("__grn", "__gn")


def global_rank(df: DataFrame, order: OrderSpec, peers: int, out: str, total: str = "__n",
                buckets: int | None = None) -> DataFrame:
    """``rank() over (order by <first ``peers`` columns of order>)`` and the row count.

    ``order`` must end with a unique key; only its first ``peers`` columns decide
    ties. A value can straddle ranges only as the value that closes one and opens the
    next ones, so two rows per range tell where each such value starts: its rank is
    the least one found for it.
    """
    bucketed = bucketize(df, order, buckets)
    names = [n for n, _ in order[:peers]]
    local = F.rank().over(Window.partitionBy(BUCKET).orderBy(*_order_cols(order[:peers])))
    ranked = bucketed.withColumn("__local", local)
    value = F.struct(*names)
    ends = ranked.groupBy(BUCKET).agg(
        F.count(F.lit(1)).alias("__cnt"), F.max("__local").alias("__last_rank"),
        F.min_by(value, "__local").alias("__first"), F.max_by(value, "__local").alias("__last"))
    ends = ends.select("*", *_offsets(ends))
    starts = ends.select(F.explode(F.array(
        F.struct(F.col("__first").alias("v"), (F.col("__offset") + 1).alias("r")),
        F.struct(F.col("__last").alias("v"), (F.col("__offset") + F.col("__last_rank")).alias("r")),
    )).alias("s")).groupBy(F.col("s.v").alias("__value")).agg(F.min("s.r").alias("__start"))
    stitch = ends.join(starts, F.col("__first").eqNullSafe(F.col("__value"))) \
        .select(BUCKET, "__offset", F.col("__n").alias("__total"), "__first", "__start")
    opens = F.col("__first").eqNullSafe(value)
    return (ranked.join(stitch, BUCKET)
            .withColumn(out, F.when(opens, F.col("__start")).otherwise(F.col("__offset") + F.col("__local")))
            .withColumnRenamed("__total", total)
            .drop(BUCKET, "__local", "__offset", "__first", "__start"))


def global_percent_rank(df: DataFrame, order: OrderSpec, peers: int, out: str,
                        buckets: int | None = None) -> DataFrame:
    """``percent_rank() over (order by <first ``peers`` columns of order>)``."""
    ranked = global_rank(df, order, peers, "__rank", "__rows", buckets)
    share = F.when(F.col("__rows") > 1, (F.col("__rank") - 1) / (F.col("__rows") - 1)).otherwise(F.lit(0.0))
    return ranked.withColumn(out, share.cast("double")).drop("__rank", "__rows")


def global_running_sum(df: DataFrame, order: OrderSpec, peers: int, value: str, out: str, total: str,
                       buckets: int | None = None) -> DataFrame:
    """``sum(value) over (order by <first ``peers`` columns of order>)`` with SQL's RANGE frame
    (rows with equal order values share one sum), and the total over all rows.

    Each range sums by itself, moved up by the sums of the ranges before. A value that
    straddles ranges is complete only in the last range that it reaches, and that range
    opens with it: the rows of the closing value of each range take their sum from there.
    """
    bucketed = bucketize(df, order, buckets)
    names = [n for n, _ in order[:peers]]
    key = F.struct(*names)
    peers_of = Window.partitionBy(BUCKET).orderBy(*_order_cols(order[:peers]))
    local = bucketed.withColumn("__local", F.sum(value).over(peers_of)).withColumn("__rank", F.rank().over(peers_of))
    ends = local.groupBy(BUCKET).agg(
        F.sum(value).alias("__sum"),
        F.min_by(F.struct(key.alias("v"), F.col("__local").alias("s")), "__rank").alias("__first"),
        F.max_by(F.struct(key.alias("v"), F.col("__local").alias("s")), "__rank").alias("__last"))
    every = Window.partitionBy(F.lit(1))
    before = F.sum("__sum").over(Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    ends = ends.select(BUCKET, "__first", "__last", F.sum("__sum").over(every).alias("__total"),
                       before.alias("__base")).checkpoint(eager=True)

    def moved(s: Column) -> Column:         # NULL only where no value came before or in the range
        return F.when(F.col("__base").isNull(), s).otherwise(F.col("__base") + F.coalesce(s, F.lit(0)))

    sums = ends.select(BUCKET, F.explode(F.array(
        F.struct(F.col("__first.v").alias("v"), moved(F.col("__first.s")).alias("s")),
        F.struct(F.col("__last.v").alias("v"), moved(F.col("__last.s")).alias("s")))).alias("e"))
    complete = sums.groupBy(F.col("e.v").alias("__value")).agg(F.max_by("e.s", BUCKET).alias("__complete"))
    stitch = ends.join(complete, F.col("__last.v").eqNullSafe(F.col("__value"))) \
        .select(BUCKET, "__base", "__total", F.col("__last.v").alias("__closing"), "__complete")
    closes = F.col("__closing").eqNullSafe(key)
    return (local.join(stitch, BUCKET)
            .withColumn(out, F.when(closes, F.col("__complete")).otherwise(moved(F.col("__local"))))
            .withColumnRenamed("__total", total)
            .drop(BUCKET, "__local", "__rank", "__base", "__closing", "__complete"))


def grouped_lag(df: DataFrame, partition: Sequence[str], order: OrderSpec, value: str, out: str,
                buckets: int | None = None) -> DataFrame:
    """``lag(value) over (partition by ... order by ...)`` safe for a hot group.

    ``partition`` + ``order`` must be a total order. Rows are ranged by the
    combined key, so a group holding a third of the data spans many ranges;
    inside a range a plain partitioned ``lag`` runs, and the first row of a
    range takes its predecessor from the row that closes the previous range.
    """
    full = [(p, True) for p in partition] + list(order)
    bucketed = bucketize(df, full, buckets)
    place = F.row_number().over(Window.partitionBy(BUCKET).orderBy(*_order_cols(full)))
    closing = (bucketed.withColumn("__place", place).groupBy(BUCKET)
               .agg(F.max_by(F.struct(*partition, F.col(value).alias("__v")), "__place").alias("__close")))
    pred = closing.select(BUCKET, F.lag("__close").over(Window.orderBy(BUCKET)).alias("__pred"))
    w = Window.partitionBy(BUCKET, *partition).orderBy(*_order_cols(order))
    same = F.lit(True)
    for p in partition:
        same = same & F.col(p).eqNullSafe(F.col(f"__pred.{p}"))
    first = F.row_number().over(w) == 1
    return (bucketed.withColumn("__lag", F.lag(value).over(w)).withColumn("__head", first)
            .join(pred, BUCKET, "left")
            .withColumn(out, F.when(F.col("__head") & F.col("__pred").isNotNull() & same, F.col("__pred.__v"))
                        .otherwise(F.col("__lag")))
            .drop("__lag", "__head", "__pred", BUCKET))
