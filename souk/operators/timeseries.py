"""Time seasonality and growth (BQ29-BQ32) and the intra-day heat-map.

All windows run over the monthly frame (one row per month) or the 7 x 24
heat-map; the data-sized work is the fact join and the grouped counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions import dates as D
from souk.functions import labels as L
from souk.functions.numeric import dbl, pct, rnd, safe_div
from souk.operators.sales import monthly_sales, seasonality_tag, valid_orders


def growth_tiers(orders: DataFrame, payments: DataFrame, cal: DataFrame) -> DataFrame:
    """Month-over-month growth with a growth tier computed on the rounded percentage.

    -> year, month_name, total_orders, total_revenue, mom_revenue_growth_pct,
       growth_performance_tag, seasonality_tag
    """
    m = monthly_sales(orders, payments, cal)
    prev = F.lag("total_revenue").over(Window.orderBy("year", "month_number"))  # one row per month
    mom = rnd(pct(F.col("total_revenue") - prev, prev))
    g = m.withColumn("mom_revenue_growth_pct", mom).orderBy("year", "month_number")
    c = F.col("mom_revenue_growth_pct")
    tag = (
        F.when(c > 20, L.GROWTH_TAGS[0]).when(c > 0, L.GROWTH_TAGS[1])
        .when(c <= 0, L.GROWTH_TAGS[2]).otherwise(L.GROWTH_TAGS[3])
    )
    return g.select(
        "year", "month_name", "total_orders",
        dbl("total_revenue").alias("total_revenue"),
        "mom_revenue_growth_pct",
        tag.alias("growth_performance_tag"),
        seasonality_tag(F.col("month_number")).alias("seasonality_tag"),
    )


def _seasonal_base(orders: DataFrame, payments: DataFrame, cal: DataFrame) -> DataFrame:
    """Monthly revenue with same-month-last-year, year mean and running total."""
    m = monthly_sales(orders, payments, cal).drop("total_orders")
    by_month = Window.partitionBy("month_number").orderBy("year")
    by_year = Window.partitionBy("year")
    running = Window.orderBy("year", "month_number")  # RANGE frame: months are unique keys
    rev = F.col("total_revenue")
    return m.select(
        "year", "month_number", "month_name", "total_revenue",
        F.lag(rev).over(by_month).alias("__prev_year"),
        safe_div(F.sum(rev).over(by_year), F.count(rev).over(by_year)).alias("__year_avg"),
        F.sum(rev).over(running).alias("__running"),
    )


def _seasonal_class(ratio: Column) -> Column:
    return (
        F.when(ratio >= 1.2, L.SEASONAL_CLASSES[0]).when(ratio.between(0.9, 1.2), L.SEASONAL_CLASSES[1])
        .when(ratio < 0.9, L.SEASONAL_CLASSES[2]).otherwise(L.SEASONAL_CLASSES[3])
    )


def _seasonal_columns(b: DataFrame, cumulative: bool) -> list[Column]:
    ratio = safe_div(F.col("total_revenue"), F.col("__year_avg"))
    cols = [
        F.col("year").cast("long").alias("year"),
        F.col("month_name"),
        rnd("total_revenue").alias("current_month_revenue"),
    ]
    if cumulative:
        cols.append(rnd("__running").alias("cumulative_revenue"))
    cols += [
        rnd(pct(F.col("total_revenue") - F.col("__prev_year"), "__prev_year")).alias("month_specific_yoy_growth_pct"),
        rnd(ratio).alias("seasonality_index"),
        _seasonal_class(ratio).alias("seasonal_classification"),
    ]
    return cols


def seasonality_index(orders: DataFrame, payments: DataFrame, cal: DataFrame) -> DataFrame:
    """Same-month year-over-year growth and revenue relative to the year's monthly mean.

    -> year, month_name, current_month_revenue, month_specific_yoy_growth_pct,
       seasonality_index, seasonal_classification
    """
    b = _seasonal_base(orders, payments, cal).orderBy("year", "month_number")
    return b.select(*_seasonal_columns(b, cumulative=False))


def cumulative_revenue(orders: DataFrame, payments: DataFrame, cal: DataFrame) -> DataFrame:
    """``seasonality_index`` plus the running revenue total since the first month.

    -> year, month_name, current_month_revenue, cumulative_revenue,
       month_specific_yoy_growth_pct, seasonality_index, seasonal_classification
    """
    b = _seasonal_base(orders, payments, cal).orderBy("year", "month_number")
    return b.select(*_seasonal_columns(b, cumulative=True))


def hour_window(hour: Column) -> Column:
    return (F.when(hour.between(12, 14), L.HOUR_WINDOWS[0]).when(hour.between(20, 22), L.HOUR_WINDOWS[1])
            .otherwise(L.HOUR_WINDOWS[2]))


def activity_heatmap(df: DataFrame, ts: str, key: str) -> DataFrame:
    """Rows per weekday (Sunday = 1) x hour of day, with the spike-window label.

    -> day_num, day_of_week, hour_of_day, total_orders, hour_window
    """
    t = F.col(ts)
    g = df.select(key, D.weekday_sunday_first(t).alias("day_num"), F.date_format(t, "EEEE").alias("day_of_week"),
                  F.hour(t).alias("hour_of_day"))
    return g.groupBy("day_of_week", "day_num", "hour_of_day").agg(F.count(key).alias("total_orders")).select(
        "day_num", "day_of_week", "hour_of_day", "total_orders", hour_window(F.col("hour_of_day")).alias("hour_window")
    ).orderBy("day_num", "hour_of_day")


def order_heatmap(orders: DataFrame) -> DataFrame:
    """Valid orders per weekday x hour of purchase."""
    return activity_heatmap(orders.where(valid_orders(orders)), "order_purchase_timestamp", "order_id")


def _union_report(seasonal: DataFrame, heat: DataFrame) -> DataFrame:
    """Seasonal rows, one separator row, then weekday-hour rows in the same columns.

    ``year`` holds years, NULL and weekday numbers; it travels as DOUBLE because
    the separator row makes it nullable.
    """
    seasonal = seasonal.withColumn("year", F.col("year").cast("double"))
    spark = seasonal.sparkSession
    names = seasonal.columns
    types = {f.name: f.dataType.simpleString() for f in seasonal.schema.fields}
    sep = spark.range(1).select(*[
        (F.lit(L.INTRADAY_SEPARATOR) if n == "month_name" else F.lit(None)).cast(types[n]).alias(n) for n in names])
    # T-SQL CONCAT reads NULL as '' (Spark's concat would return NULL)
    label = F.concat(F.coalesce(F.col("day_of_week"), F.lit("")), F.lit(" at "),
                     F.coalesce(F.col("hour_of_day").cast("string"), F.lit("")), F.lit(":00"))
    fill = {
        "year": F.col("day_num").cast(types["year"]),
        "month_name": label,
        "current_month_revenue": F.col("total_orders").cast(types["current_month_revenue"]),
        "seasonal_classification": F.col("hour_window"),
    }
    intraday = heat.select(*[fill.get(n, F.lit(None).cast(types[n])).alias(n) for n in names])
    return seasonal.unionByName(sep).unionByName(intraday).orderBy("year", "month_name")


def seasonality_report(orders: DataFrame, payments: DataFrame, cal: DataFrame) -> DataFrame:
    """BQ31 report: seasonality rows + separator + "Sunday at 0:00"-style rows."""
    return _union_report(seasonality_index(orders, payments, cal), order_heatmap(orders))


def cumulative_report(orders: DataFrame, payments: DataFrame, cal: DataFrame) -> DataFrame:
    """BQ32 report: cumulative seasonality rows + separator + weekday-hour rows."""
    return _union_report(cumulative_revenue(orders, payments, cal), order_heatmap(orders))
