"""T-SQL date-boundary rules, calendar attributes and rounding, checked by brute force."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from souk.functions import dates as D
from souk.functions.numeric import avg_truncated, rnd, safe_div
from souk.sources.calendar import calendar, calendar_check


def _one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).collect()[0]
    return row.x


def test_hour_boundaries(spark):
    a, b = dt.datetime(2020, 1, 1, 10, 59), dt.datetime(2020, 1, 1, 11, 1)
    assert _one(spark, D.hours_between_boundaries("a", "b"), a=a, b=b) == 1
    assert _one(spark, D.hours_between_boundaries("a", "b"), a=b, b=dt.datetime(2020, 1, 1, 11, 59)) == 0


def test_month_boundaries(spark):
    a, b = dt.datetime(2020, 1, 31, 23, 0), dt.datetime(2020, 2, 1, 0, 1)
    assert _one(spark, D.months_between_boundaries("a", "b"), a=a, b=b) == 1
    assert _one(spark, D.months_between_boundaries("a", "b"), a=dt.datetime(2020, 2, 1), b=dt.datetime(2020, 2, 29)) == 0
    assert _one(spark, D.months_between_boundaries("a", "b"), a=dt.datetime(2019, 12, 15), b=dt.datetime(2020, 3, 1)) == 3


def test_day_boundaries(spark):
    a, b = dt.datetime(2020, 1, 1, 23, 59), dt.datetime(2020, 1, 2, 0, 1)
    assert _one(spark, D.days_between("a", "b"), a=a, b=b) == 1


def _tsql_week(d: dt.date) -> int:
    """DATEPART(week) with DATEFIRST 1: 1 + Mondays in (Jan 1, d]."""
    jan1 = dt.date(d.year, 1, 1)
    return 1 + sum(1 for k in range(1, (d - jan1).days + 1) if (jan1 + dt.timedelta(k)).weekday() == 0)


def _sunday_weeks(a: dt.date, b: dt.date) -> int:
    """DATEDIFF(week, a, b): Sundays in (a, b]."""
    return sum(1 for k in range(1, (b - a).days + 1) if (a + dt.timedelta(k)).weekday() == 6)


def test_calendar_matches_brute_force(spark):
    cal = calendar(spark, "2016-01-01", "2020-04-30")
    check = calendar_check(cal).collect()[0]
    assert check.day_count == 1582
    assert (check.min_date, check.max_date) == (dt.date(2016, 1, 1), dt.date(2020, 4, 30))
    for r in cal.collect():
        d = r.full_date
        assert r.datekey == int(d.strftime("%Y%m%d"))
        assert r.week_of_year == _tsql_week(d), d
        assert r.week_of_month == _sunday_weeks(d.replace(day=1), d) + 1, d
        assert r.day_of_week == d.weekday() + 1
        assert r.is_weekend == (d.weekday() >= 5)
        assert r.semester == (1 if d.month <= 6 else 2)
        assert r.month_name == d.strftime("%B") and r.day_name == d.strftime("%A")


def test_round_half_away_from_zero_through_decimal(spark):
    assert _one(spark, rnd("x"), x=1.005) == 1.01
    assert _one(spark, rnd("x", 0), x=-2.5) == -3.0
    assert _one(spark, rnd("x"), x=Decimal("136.225")) == 136.23
    assert _one(spark, rnd("x"), x=2.6749996) == 2.67       # one rounding, not two
    assert _one(spark, rnd("x"), x=-2.6749996) == -2.67


def test_safe_div_and_truncated_avg(spark):
    assert _one(spark, safe_div("a", "b"), a=1, b=0) is None
    df = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    assert df.agg(avg_truncated("x").alias("a")).collect()[0].a == 1
    assert df.agg(avg_truncated(-F.col("x")).alias("a")).collect()[0].a == -1   # toward zero
    big = spark.createDataFrame([(2 ** 53,), (2 ** 53 + 2,)], "x long")
    assert big.agg(avg_truncated("x").alias("a")).collect()[0].a == 2 ** 53 + 1
    assert df.where("x > 5").agg(avg_truncated("x").alias("a")).collect()[0].a is None


def test_weekday_numbering(spark):
    sunday = dt.datetime(2017, 1, 1, 0, 0)
    assert _one(spark, D.weekday_sunday_first("t"), t=sunday) == 1
    assert _one(spark, D.weekday_monday_first("t"), t=sunday) == 7
    assert _one(spark, F.date_format("t", "EEEE"), t=sunday) == "Sunday"
