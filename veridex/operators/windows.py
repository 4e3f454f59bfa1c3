"""Windowed state over event logs in batch form: rate limits and cache replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_limited(events: DataFrame, ts: str, client: Column, width: str, most: int) -> DataFrame:
    """Requests of each client in fixed windows aligned to the epoch, and whether they exceed the limit."""
    g = events.groupBy(F.window(ts, width).alias("w"), client.alias("client")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), "client", "n", (F.col("n") > most).alias("limited"))


def ttl_hits(reads: DataFrame, ttl_seconds: int) -> DataFrame:
    """id and hit of reads (id, ts, key): a read hits if its key was read (and so set) less than the TTL before.

    Every read refreshes its entry, so only the read before matters; capacity is not limited here.
    """
    w = Window.partitionBy("key").orderBy("ts", "id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    age = at - F.lag(at).over(w)
    return reads.select("id", F.coalesce(age < ttl_seconds * 1_000_000, F.lit(False)).alias("hit"))


def lru_replay(trace: DataFrame, capacity: int, ttl_ms: int) -> DataFrame:
    """hits, misses, evictions and entries of a cache's trace (cache, seq, op, key, at_ms), one row a cache.

    Eviction depends on all operations before, so each cache's trace is folded in order in one task.
    """

    def fold(key, pdf):
        import pandas as pd

        kept: dict[str, int] = {}
        hits = misses = evictions = 0
        for op, k, at in pdf.sort_values("seq")[["op", "key", "at_ms"]].itertuples(index=False):
            if op == "get":
                if k in kept and at < kept[k]:
                    kept[k] = kept.pop(k)
                    hits += 1
                else:
                    kept.pop(k, None)
                    misses += 1
            elif capacity > 0:
                kept.pop(k, None)
                kept[k] = at + ttl_ms
                while len(kept) > capacity:
                    kept.pop(next(iter(kept)))
                    evictions += 1
        return pd.DataFrame([(key[0], hits, misses, evictions, len(kept))], columns=["cache", "hits", "misses", "evictions", "entries"])

    return trace.groupBy("cache").applyInPandas(fold, "cache string, hits long, misses long, evictions long, entries long")
