"""Hashes as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a_32(text: Column) -> Column:
    """32-bit FNV-1a over character codes, as a non-negative bigint."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c.cast("bigint")) * F.lit(16777619).cast("bigint")) % F.lit(4294967296).cast("bigint"))


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))
