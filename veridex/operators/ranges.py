"""Addresses joined with ranges (CIDR blocks): the longest range that holds an address, or the first of a list.

An address is 128 bits in two bigints (IPv4 is ::ffff:0:0/96), a range its masked base and its length. An address
looks for itself, masked, once for each length that occurs: equality joins, never a comparison of ranges. Only
different addresses look, so a repeated one costs one look. Ranges of up to 16 bits (of either family) are at most
2 * 131,071, and are broadcast; longer ones are joined by shuffling, where a prefix that holds very many different
addresses is split by adaptive execution. That they are is said by a hint, as Spark takes the looks for as few as
the addresses and would broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions.net import ipv4_value, ipv6_words, is_ipv4, let

_MAPPED = 0xFFFF << 32
SHORT_BITS = 16


def address_key(ip: Column) -> Column:
    """struct(hi, lo) of an address, null if it is malformed."""
    half = lambda w, at: F.aggregate(F.slice(w, at, 4), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 16).bitwiseOR(x.cast("bigint")))
    six = let(ipv6_words(ip), lambda w: F.when(w.isNotNull(), F.struct(half(w, 1).alias("hi"), half(w, 5).alias("lo"))))
    four = F.struct(F.lit(0).cast("bigint").alias("hi"), (ipv4_value(ip) + F.lit(_MAPPED)).alias("lo"))
    return F.when(ip.contains(":"), six).when(is_ipv4(ip), four)


def _kept(word: Column, bits: Column) -> Column:
    """The first bits (0 to 64) of a word, the rest zero."""
    ones = F.call_function("shiftleft", F.lit(-1).cast("bigint"), 64 - bits)
    return F.when(bits <= 0, F.lit(0).cast("bigint")).when(bits >= 64, word).otherwise(word.bitwiseAND(ones))


def masked(key: Column, bits: Column) -> Column:
    """struct(hi, lo, bits): the range of so many bits (0 to 128) that holds the address."""
    return F.struct(_kept(key["hi"], bits).alias("hi"), _kept(key["lo"], bits - 64).alias("lo"), bits.cast("int").alias("bits"))


def range_bits(cidr: Column) -> Column:
    """The length of 'address/length' in 128 bits, without a look at the address; null if malformed."""
    most = F.when(cidr.contains(":"), 128).otherwise(32)
    last = F.substring_index(cidr, "/", -1)
    n = F.when(cidr.contains("/") & last.rlike(r"^\d{1,3}$"), last.try_cast("int"))
    return F.when(n <= most, n + 128 - most)


def range_join(rows: DataFrame, address: str, ranges: DataFrame, order: str | None = None) -> DataFrame:
    """rows with a struct column `range`: the row of ranges (cidr, ...) that decides about the address; null if none holds it.

    Without `order` the longest range decides, and of equal ones the least in its values; with it the range of the
    least value in that column, as in a list of rules of which the first that fits counts. Malformed addresses
    and null ones get null, malformed ranges hold nothing. Every row of rows stays, once; a column named range is
    replaced.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in ranges.columns])
    row = ranges.select(address_key(F.substring_index(F.col("cidr"), "/", 1)).alias("key"), range_bits(F.col("cidr")).alias("length"), (F.col(f"`{order}`") if order else F.lit(0)).alias("rank"), whole.alias("range"))
    held = F.when(F.col("key").isNotNull() & F.col("length").isNotNull(), masked(F.col("key"), F.col("length")))
    known = row.select(held.alias("held"), "rank", "range").select("held.*", "rank", "range").groupBy("hi", "lo", "bits")
    # keys come out as aggregates: a filter of a group's own key goes below the shuffle, and every range would be read once more for each
    known = known.agg(*[F.max(c).alias(f"held_{c}") for c in ("hi", "lo", "bits")], F.min(F.struct("rank", "range")).alias("best")).select(*[F.col(f"held_{c}").alias(c) for c in ("hi", "lo", "bits")], "best.*")
    lengths = sorted(r["bits"] for r in ranges.select(range_bits(F.col("cidr")).alias("bits")).distinct().collect() if r["bits"] is not None)  # 129 at most
    rows = rows.drop("range")
    if not lengths:
        return rows.withColumn("range", F.lit(None).cast(ranges.schema))
    own = F.col(f"`{address}`")
    asked = rows.select(F.inline(F.array(F.struct(own.alias("address"), address_key(own).alias("key"))))).filter("key is not null").distinct()  # read before the shuffle, once a row
    looks = asked.select("address", F.explode(F.array(*[masked(F.col("key"), F.lit(n)) for n in lengths])).alias("look")).select("address", "look.*")
    mapped = (F.col("hi") == 0) & (F.shiftright("lo", 32) == 0xFFFF)
    short = (F.col("bits") <= SHORT_BITS) | (mapped & F.col("bits").between(96, 96 + SHORT_BITS))
    found = [looks.filter(short).join(F.broadcast(known.filter(short)), ["hi", "lo", "bits"]), looks.filter(~short).hint("merge").join(known.filter(~short), ["hi", "lo", "bits"])]
    rank = F.struct("rank", "range") if order else F.struct(-F.col("bits"), "range")
    best = found[0].unionByName(found[1]).groupBy("address").agg(F.min_by("range", rank).alias("range"))
    return rows.join(best.withColumnRenamed("address", "_address").hint("merge"), own == F.col("_address"), "left").drop("_address")
