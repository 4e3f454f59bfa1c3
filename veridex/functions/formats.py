"""Payload checks of machine-readable codes, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridex import dims


def normal_format(raw: Column) -> Column:
    names = F.create_map(*[x for k, v in dims.FORMAT_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(names, raw), F.lit("UNKNOWN"))


def check_digit_ok(digits: Column) -> Column:
    """8 or 12 to 14 digits whose last one makes the 3-1 weighted sum from the right a multiple of ten."""
    number = digits.try_cast("bigint")
    total = number % 10
    for k in range(1, 14):  # from the right; leading zeros add nothing
        total = total + F.call_function("div", number, F.lit(10**k)) % 10 * (3 if k % 2 else 1)
    return F.coalesce(F.when(digits.rlike(r"^(\d{8}|\d{12,14})$"), total % 10 == 0), F.lit(False))


def payload_kind(fmt: Column) -> Column:
    return F.when(fmt.isin(dims.RETAIL_FORMATS), "gtin").when(fmt.isin(dims.NUMERIC_FORMATS), "numeric_code").when(fmt == "Codabar", "alphanumeric").otherwise("binary_or_unknown")


def payload_valid(value: Column, fmt: Column) -> Column:
    n = F.char_length(value)
    digits = F.when(fmt == "EAN-13", 13).when(fmt == "EAN-8", 8).when(fmt == "UPC-A", 12)
    return (
        F.when(digits.isNotNull(), (n == digits) & check_digit_ok(value))
        .when(fmt == "UPC-E", value.rlike(r"^0\d{6}$"))
        .when(fmt.isin(dims.NUMERIC_FORMATS), (n >= 4) & value.rlike(r"^[\x20-\x7e]+$"))
        .when(fmt == "Codabar", (n >= 4) & value.rlike(r"^[A-Da-d]?[0-9\-$:/.+]+[A-Da-d]?$"))
        .otherwise(n > 0)
    )


def is_indian_gs1(value: Column) -> Column:
    return value.rlike(r"^890\d{10}$")


def is_url_payload(value: Column, fmt: Column) -> Column:
    return (fmt == "QR Code") & value.rlike("(?i)^https?://")


def bounding_box(points: Column) -> Column:
    """Rounded box around an array of points (x, y); null for none."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    lo_x, lo_y = F.array_min(x), F.array_min(y)
    up = lambda v: F.floor(v + 0.5).cast("double")
    return F.when(F.size(points) > 0, F.struct(up(lo_x).alias("x"), up(lo_y).alias("y"), up(F.array_max(x) - lo_x).alias("width"), up(F.array_max(y) - lo_y).alias("height")))
