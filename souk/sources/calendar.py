"""Generated date dimension (one row per day) and date keys on facts."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions import dates as D

# Bound that makes broadcasting the calendar safe: ~270 years of days.
MAX_CALENDAR_DAYS = 100_000


def calendar(spark: SparkSession, start: str | _dt.date, end: str | _dt.date) -> DataFrame:
    """Date dimension from ``start`` to ``end`` inclusive.

    Columns: datekey (yyyyMMdd int), full_date, year, semester, quarter,
    month_number, month_name, week_of_year (week 1 holds Jan 1, Monday start),
    week_of_month (Sunday boundaries), day_name, day_of_week (Monday = 1),
    day_of_month, day_of_year, is_weekend.

    Built with ``sequence`` + ``explode``; the row count is known from the
    arguments, which is what makes broadcasting it safe.
    """
    s = _dt.date.fromisoformat(str(start))
    e = _dt.date.fromisoformat(str(end))
    days = (e - s).days + 1
    if days <= 0 or days > MAX_CALENDAR_DAYS:
        raise ValueError(f"calendar range of {days} days is outside 1..{MAX_CALENDAR_DAYS}")
    base = spark.range(1).select(
        F.explode(F.sequence(F.lit(s), F.lit(e), F.expr("interval 1 day"))).alias("full_date"))
    return base.select(*_attributes(F.col("full_date")))


def calendar_spanning(df: DataFrame, start_col: str, end_col: str) -> DataFrame:
    """Calendar over whole years covering ``min(start_col)`` .. ``max(end_col)`` of ``df``.

    The date range comes from the data (one row of bounds reaches the driver), so no
    fact falls outside, and it passes the same day-count check as a given range: one
    bad date centuries away raises instead of widening what is broadcast. Without any
    date the calendar covers a single day that matches nothing in ``df``.
    """
    low, high = df.agg(F.year(F.min(start_col)), F.year(F.max(end_col))).first()
    if low is None or high is None:
        return calendar(df.sparkSession, "1970-01-01", "1970-01-01")
    return calendar(df.sparkSession, _dt.date(low, 1, 1), _dt.date(high, 12, 31))


def _attributes(d):
    return [
        D.datekey(d).alias("datekey"),
        d.alias("full_date"),
        F.year(d).alias("year"),
        F.when(F.month(d) <= 6, 1).otherwise(2).alias("semester"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        D.week_of_year(d).alias("week_of_year"),
        D.week_of_month(d).alias("week_of_month"),
        F.date_format(d, "EEEE").alias("day_name"),
        D.weekday_monday_first(d).alias("day_of_week"),
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofyear(d).alias("day_of_year"),
        D.weekday_monday_first(d).isin(6, 7).alias("is_weekend"),
    ]


def calendar_check(cal: DataFrame) -> DataFrame:
    """Sanity row: min date, max date, day count."""
    return cal.agg(F.min("full_date").alias("min_date"), F.max("full_date").alias("max_date"),
                   F.count(F.lit(1)).alias("day_count"))


def add_datekeys(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Add ``yyyyMMdd`` int keys: ``{source_timestamp_col: new_key_col}``."""
    return df.withColumns({dst: D.datekey(src) for src, dst in mapping.items()})


def join_calendar(fact: DataFrame, cal: DataFrame, fact_key: str = "purchase_datekey",
                  columns: tuple[str, ...] = ("year", "month_number", "month_name")) -> DataFrame:
    """Inner join a fact to the calendar on its int date key.

    The calendar is bounded by construction (``MAX_CALENDAR_DAYS``), so it is
    broadcast and the fact side is never shuffled for this join.
    """
    dim = cal.select(F.col("datekey").alias(fact_key), *columns)
    return fact.join(F.broadcast(dim), fact_key)
