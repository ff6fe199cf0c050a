"""Column helpers for missing, infinite and rounded numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: Column | str) -> Column:
    """NULL for NULL or NaN, else the value."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def is_missing(c: Column | str) -> Column:
    c = col(c)
    return c.isNull() | F.isnan(c)


def is_infinite(c: Column | str) -> Column:
    """True for +inf or -inf; NULL and NaN count as False."""
    return F.coalesce(F.abs(known(c)) == F.lit(float("inf")), F.lit(False))


def is_finite(c: Column | str) -> Column:
    return F.coalesce(F.abs(known(c)) < F.lit(float("inf")), F.lit(False))


def finite(c: Column | str) -> Column:
    """NULL unless the value is a finite number."""
    return F.when(is_finite(c), col(c))


def safe_div(a: Column, b: Column) -> Column:
    """NULL where the divisor is zero."""
    return F.try_divide(a, b)


def half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
