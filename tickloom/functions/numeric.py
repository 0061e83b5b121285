"""Column helpers that keep pandas' missing-value arithmetic while staying NULL-only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def pdiv(a: Column, b: Column) -> Column:
    """``a / b`` with ``x/0 = +-inf`` and ``0/0`` missing (plain ``/`` raises under ANSI)."""
    a = a.cast("double")
    b = b.cast("double")
    return (F.when(b != 0, a / b)
            .when((b == 0) & (a > 0), F.lit(INF)).when((b == 0) & (a < 0), F.lit(-INF)))


def finite(x: Column) -> Column:
    """NaN and +-inf become NULL, as rolling and exponential inputs require."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(INF)), x)


def clip_low(x: Column, bound: float) -> Column:
    """Lower bound that leaves NULL alone (bare ``greatest`` would return the bound)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(bound))))


def clip_high(x: Column, bound: float) -> Column:
    return F.when(x.isNotNull(), F.least(x, F.lit(float(bound))))


def flag(condition: Column) -> Column:
    """Condition as 0/1; an unknown condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def holds(condition: Column) -> Column:
    """Condition with unknown read as false."""
    return F.coalesce(condition, F.lit(False))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def epoch_second(t: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, independent of the session zone."""
    day = F.unix_date(F.to_date(t)).cast("long")
    return day * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
