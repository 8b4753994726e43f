"""T-SQL date semantics as Spark column expressions.

T-SQL ``DATEDIFF(unit, a, b)`` counts unit *boundaries* crossed, which is not
what Spark's ``timestampdiff``/``months_between`` return (those count whole
elapsed units). Each helper here reproduces the boundary rule with built-in,
codegen-friendly functions.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# 1899-12-31 was a Sunday; T-SQL week boundaries fall on Sundays regardless of DATEFIRST.
_SUNDAY_EPOCH = _dt.date(1899, 12, 31)


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ts(x: ColumnOrName) -> Column:
    """As TIMESTAMP; wall-clock (NTZ) inputs are read in the session zone (UTC)."""
    return _c(x).cast("timestamp")


def days_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``DATEDIFF(day, start, end)``: midnights crossed (both sides cast to date)."""
    return F.datediff(F.to_date(_c(end)), F.to_date(_c(start)))


def months_between_boundaries(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``DATEDIFF(month, start, end)``: month boundaries crossed."""
    s, e = _c(start), _c(end)
    return (F.year(e) * 12 + F.month(e)) - (F.year(s) * 12 + F.month(s))


def weeks_between_boundaries(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``DATEDIFF(week, start, end)``: Sunday boundaries crossed."""
    anchor = F.lit(_SUNDAY_EPOCH)
    return (F.floor(F.datediff(F.to_date(_c(end)), anchor) / 7)
            - F.floor(F.datediff(F.to_date(_c(start)), anchor) / 7)).cast("int")


def hours_between_boundaries(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``DATEDIFF(hour, start, end)``: hour boundaries crossed (10:59 -> 11:01 is 1)."""
    return ((F.unix_seconds(F.date_trunc("hour", _ts(end)))
             - F.unix_seconds(F.date_trunc("hour", _ts(start)))) / 3600).cast("long")


def seconds_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``DATEDIFF(second, start, end)`` as a bigint (no overflow on long spans)."""
    return F.unix_seconds(_ts(end)) - F.unix_seconds(_ts(start))


def weekday_monday_first(d: ColumnOrName) -> Column:
    """``DATEPART(weekday, d)`` under ``SET DATEFIRST 1``: Monday = 1 ... Sunday = 7."""
    return F.weekday(_c(d)) + 1


def weekday_sunday_first(d: ColumnOrName) -> Column:
    """``DATEPART(dw, d)`` with the default DATEFIRST 7: Sunday = 1 ... Saturday = 7."""
    return F.dayofweek(_c(d))


def week_of_year(d: ColumnOrName) -> Column:
    """``DATEPART(week, d)`` with DATEFIRST 1: week 1 holds Jan 1, weeks start Monday."""
    x = _c(d)
    jan1 = F.trunc(x, "year")
    return (F.floor((F.dayofyear(x) - 1 + F.weekday(jan1)) / 7) + 1).cast("int")


def week_of_month(d: ColumnOrName) -> Column:
    """``DATEDIFF(week, DATEFROMPARTS(y, m, 1), d) + 1``."""
    x = _c(d)
    return weeks_between_boundaries(F.trunc(x, "month"), x) + 1


def month_start(d: ColumnOrName) -> Column:
    """``DATEFROMPARTS(year(d), month(d), 1)``."""
    return F.trunc(F.to_date(_c(d)), "month")


def datekey(d: ColumnOrName) -> Column:
    """``CONVERT(int, FORMAT(d, 'yyyyMMdd'))``."""
    return F.date_format(_c(d), "yyyyMMdd").cast("int")


def year_month_text(d: ColumnOrName) -> Column:
    """``CONVERT(char(7), d, 120)`` -> ``yyyy-MM``."""
    return F.date_format(_c(d), "yyyy-MM")
