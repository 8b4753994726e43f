"""Numeric helpers shared by every operator.

Rounding is one cast to DECIMAL, as the reference casts results to ``decimal(p,2)``
(half away from zero). Results are returned as DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd_decimal(x: ColumnOrName, digits: int = 2) -> Column:
    """``CAST(x AS decimal(p, digits))``, kept exact for a later sum of rounded values."""
    return _c(x).cast(f"decimal(38,{digits})")


def rnd(x: ColumnOrName, digits: int = 2) -> Column:
    """``CAST(x AS decimal(p, digits))`` semantics, returned as DOUBLE."""
    return rnd_decimal(x, digits).cast("double")


def dbl(x: ColumnOrName) -> Column:
    return _c(x).cast("double")


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / NULLIF(den, 0)`` in DOUBLE (NULL instead of an ANSI error)."""
    d = dbl(den)
    return F.when(d != 0, dbl(num) / d)


def pct(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``100.0 * num / NULLIF(den, 0)``."""
    return safe_div(dbl(num) * 100.0, den)


def avg_double(x: ColumnOrName) -> Column:
    """``AVG(x * 1.0)``: average in DOUBLE from an exact sum and count."""
    return safe_div(F.sum(_c(x)), F.count(_c(x)))


def avg_truncated(x: ColumnOrName) -> Column:
    """T-SQL ``AVG(int_col)``: integer average, truncated toward zero."""
    s, n = F.sum(_c(x)).cast("long"), F.count(_c(x))
    return F.when(n > 0, F.call_function("div", s, n))


def truncate_int(x: ColumnOrName) -> Column:
    """``CAST(x AS int)`` from a fractional value: truncation toward zero."""
    return _c(x).cast("long")


def count_if(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` as BIGINT."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")
