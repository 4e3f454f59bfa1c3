"""Rates, floor-rank percentiles and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridex.functions.net import let


def rate(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part / whole * scale; null where whole is 0."""
    return F.try_divide(part.cast("double") * F.lit(scale), whole.cast("double"))


def rate_or_zero(part: Column, whole: Column, scale: float = 1.0) -> Column:
    return F.coalesce(rate(part, whole, scale), F.lit(0.0))


def floor_rank(values: Column, percent: int) -> Column:
    """The element of rank min(n - 1, floor(percent / 100 * n)) of an array; null if empty. No interpolation."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(v)
    return F.get(v, F.least(n - 1, F.floor(n * percent / F.lit(100.0)).cast("int")))


def rounded(x: Column) -> Column:
    """To the nearest integer, halves up (also below zero)."""
    return F.floor(x + F.lit(0.5))


def percent_text(x: Column) -> Column:
    return F.coalesce(F.concat(rounded(x).cast("string"), F.lit("%")), F.lit("N/A"))


def millis_text(x: Column) -> Column:
    return F.coalesce(F.concat(x.cast("string"), F.lit(" ms")), F.lit("---"))


def fixed(x: Column, digits: int = 3) -> Column:
    """x (0 or more) to so many decimals, half up by its exact binary value, as fixed-point formatting of doubles does.

    The product with the power of ten is kept in two parts that doubles hold exactly.
    """
    scale = float(10**digits)

    def rounded(v: Column) -> Column:
        high = F.floor(v * 67108864.0) / 67108864.0
        a, b = high * scale, (v - high) * scale
        k = F.floor(a)
        return (k + F.when(a - k - 0.5 >= -b, 1).otherwise(0)) / scale

    return let(x, rounded)
