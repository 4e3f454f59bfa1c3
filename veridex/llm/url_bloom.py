"""URL filter: rules first, else a blocked Bloom filter of listed canonical URLs before an exact hash join.

The filter has blocks of 256 bits (eight words of 32, one bit set in each), so a lookup touches one cache line.
It is built on the executors, merged block by block, and never larger than a given number of blocks; beyond that
it only passes more URLs. What it passes goes to an exact join with the list, which removes false positives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridex.llm.common import ship

MOST_BLOCKS = 1 << 17  # of 32 bytes: 4 MiB are broadcast at most
BITS_PER_URL = 16
MOST_RULES = 500
#: The eight odd multipliers of split-block Bloom filters, as in the Parquet format.
_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without '://'."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """What the list and the pages are matched by: host and path without trailing slashes."""
    return F.concat(host, F.regexp_replace(path, r"/+$", ""))


def rule_of(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """value(rule) of the longest rule that fits: its host or a subdomain, and a path that starts with its path."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules; list single URLs instead")
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = out.when(fits, value(r)) if out is not None else F.when(fits, value(r))
    return out if out is not None else F.lit(None).cast("string")


def _words(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and the eight masks of each hash."""
    h = h.view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = h & np.uint64(0xFFFFFFFF)
    bit = ((low[:, None] * _SALTS[None, :]) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
    return block.astype(np.int64), (np.uint32(1) << bit.astype(np.uint32))


def built(keys: DataFrame, key: str, most_blocks: int = MOST_BLOCKS) -> np.ndarray:
    """The filter of the distinct values of a column: at most `most_blocks` blocks x 8 words."""
    ship(keys.sparkSession)
    n = keys.agg(F.approx_count_distinct(key)).first()[0]
    blocks = int(min(most_blocks, max(1, -(-n * BITS_PER_URL // 256))))
    names = [f"w{i}" for i in range(8)]
    schema = T.StructType([T.StructField("block", T.IntegerType()), *[T.StructField(w, T.IntegerType()) for w in names]])

    def run(batches):
        own = np.zeros((blocks, 8), np.uint32)
        for b in batches:
            at, mask = _words(b.column(0).to_numpy(zero_copy_only=False), blocks)
            np.bitwise_or.at(own, at, mask)
        some = np.flatnonzero(own.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(own[some, i].view(np.int32)) for i in range(8)]], names=schema.names)

    parts = keys.select(F.xxhash64(key)).mapInArrow(run, schema)
    rows = parts.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in names]).collect()  # at most most_blocks rows
    out = np.zeros((blocks, 8), np.uint32)
    for r in rows:
        out[r[0]] = np.array(r[1:], np.int32).view(np.uint32)
    return out


def passes(spark: SparkSession, bloom: np.ndarray, key: Column) -> Column:
    """Whether the filter passes the key; never false for a listed key. Only hashes of keys go to Python."""
    shared = spark.sparkContext.broadcast(bloom)

    @F.arrow_udf(T.BooleanType())
    def passed(h: pa.Array) -> pa.Array:
        f = shared.value
        at, mask = _words(h.to_numpy(zero_copy_only=False), len(f))
        return pa.array(((f[at] & mask) == mask).all(axis=1))

    return passed(F.xxhash64(key))


def judged(pages: DataFrame, listed: DataFrame, rules: list[Rule], most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """pages (page_id, url) with host, path, rule and verdict for every row.

    listed: a column `key` of canonical URLs (nulls and repeats do no harm). Beyond some two million of them for
    each MOST_BLOCKS, raise most_blocks (32 bytes each are broadcast), or more URLs go to the join. A rule's verdict wins; without one a
    listed URL is blocked, others are allowed. Null or malformed URLs have empty host and path, match no rule and
    are allowed unless the empty key is listed. Columns named like the four are replaced, all others stay.
    """
    host, path = host_and_path()
    ship(pages.sparkSession)
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    h, p = F.col("host"), F.col("path")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), host.alias("host"), path.alias("path"))  # one column, so that no name of theirs meets one of ours
    rows = rows.withColumns({"key": canonical(h, p), "rule": rule_of(h, p, rules, lambda r: F.lit(r.name)), "told": rule_of(h, p, rules, lambda r: F.lit(r.verdict))})
    keys = listed.select("key").filter("key is not null")
    seen = rows.withColumn("possible", passes(pages.sparkSession, built(keys, "key", most_blocks), F.col("key")))
    exact = keys.select(F.col("key").alias("list_key")).distinct().withColumn("listed", F.lit(True))
    hits = seen.filter("possible").join(exact.hint("shuffle_hash"), F.col("key") == F.col("list_key"), "left").drop("list_key")
    rest = seen.filter("not possible").withColumn("listed", F.lit(None).cast("boolean"))
    verdict = F.coalesce(F.col("told"), F.when(F.col("listed"), "block").otherwise("allow"))
    return hits.unionByName(rest).select(*[F.col(f"row.`{c}`") for c in own], "host", "path", "rule", verdict.alias("verdict"))
