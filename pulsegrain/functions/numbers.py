"""Rounding, and ratios that never divide by zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(value: Column, digits: int) -> Column:
    """Round half away from zero on the scaled value: ``round(x * 100) / 100`` for two digits.

    ``F.round(x, 2)`` rounds the printed decimal instead, and takes 146.575 up although the stored
    number lies just below it.
    """
    scale = F.lit(float(10 ** digits))
    return F.round(value.cast("double") * scale) / scale


def ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    """``a / b``, 0 where ``b`` is 0 or NULL."""
    value = F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return value if digits is None else rounded(value, digits)


def percent(a: Column, b: Column) -> Column:
    """``a`` as a percentage of ``b`` with two digits, 0 where ``b`` is 0."""
    return rounded(ratio(a, b) * 100, 2)
