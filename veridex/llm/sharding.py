"""Minimax contiguous partition of ordered atomic groups into shards; DataFrame operations only.

Groups of equal texts are put in the order of their digest, and ranges of digests (units) are summed up by Spark.
The smallest capacity for which a greedy walk needs at most `shards` shards is found by binary search over the
units, once as if cuts could fall anywhere inside a unit and once as if only between units; the true capacity lies
between. Units in which a cut may fall are split by further digits until none is left that holds several groups.
So the driver sees sums of units only, never the groups.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.llm.common import removed, written

SHARDS = 8
#: Hex digits of the first units and of each split; units split at a time. The driver gets at most 16 ** CELL_DIGITS
#: units, and SPLIT_UNITS * 16 ** SPLIT_DIGITS more in each round.
CELL_DIGITS = 3
SPLIT_DIGITS = 2
SPLIT_UNITS = 64
SLOT_DIGITS = 3


def text_size(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def digest(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def _cell(c: str | Column, digits: int) -> Column:
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("int")


class Units:
    """Ranges of the ordered groups: digest prefix, bytes, number of groups, largest group."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self._put(self._summed(groups, CELL_DIGITS))

    def _summed(self, groups: DataFrame, digits: int) -> list[tuple]:
        rows = groups.groupBy(F.substring("digest", 1, digits).alias("unit")).agg(F.sum("bytes"), F.count("*"), F.max("bytes"))
        return [tuple(r) for r in rows.collect()]  # bounded: see SPLIT_UNITS

    def _put(self, units: list[tuple]) -> None:
        self.units = sorted(units)
        self.ends = list(accumulate(u[1] for u in self.units))
        self.total = self.ends[-1] if units else 0
        self.largest = max((u[3] for u in units), default=0)

    def split(self, some: list[int]) -> None:
        """Put the parts of these units in their place."""
        gone = {self.units[i][0] for i in some}
        parts = []
        for digits in {len(p) for p in gone}:
            names = sorted(p for p in gone if len(p) == digits)
            near = (F.col("digest") >= names[0]) & (F.col("digest") < names[-1] + "g")  # reaches the scan
            parts += self._summed(self.groups.filter(near & F.substring("digest", 1, digits).isin(names)), digits + SPLIT_DIGITS)
        self._put([u for u in self.units if u[0] not in gone] + parts)

    def reach(self, most: int, anywhere: bool) -> int:
        """Where the last group ends that ends at or before `most`; for a cut inside a unit `most` itself or the unit's start."""
        i = bisect_right(self.ends, most)
        start = self.ends[i - 1] if i else 0
        return most if anywhere and i < len(self.ends) and self.units[i][2] > 1 else start

    def walk(self, capacity: int, shards: int, anywhere: bool) -> list[int] | None:
        """Cuts of the greedy walk; None if `shards` shards don't do."""
        cuts, start = [], 0
        for _ in range(shards):
            if start + capacity >= self.total:
                return cuts
            at = self.reach(start + capacity, anywhere)
            if at <= start:
                return None
            cuts.append(at)
            start = at
        return None

    def least(self, shards: int, anywhere: bool) -> int:
        lo, hi = max(self.largest, -(-self.total // shards)), self.total
        while lo < hi:
            m = (lo + hi) // 2
            lo, hi = (lo, m) if self.walk(m, shards, anywhere) is not None else (m + 1, hi)
        return lo

    def open_units(self, lo: int, hi: int, shards: int) -> list[int]:
        """Units of several groups in which a cut may fall for a capacity from lo to hi."""
        out, a, b = [], 0, 0
        for _ in range(shards - 1):
            a, b = self.reach(a + lo, False), self.reach(b + hi, True)  # no earlier, no later than the true cut
            out += [i for i in range(bisect_right(self.ends, a), min(len(self.ends), bisect_right(self.ends, b) + 1)) if self.units[i][2] > 1]
        return sorted(set(out))

    def solve(self, shards: int) -> tuple[int, list[str]]:
        """The smallest capacity that does, and for each cut of its greedy walk the prefix of the last digest before it."""
        if not self.total:
            return 0, []
        while True:
            lo, hi = self.least(shards, True), self.least(shards, False)
            near = self.open_units(lo, hi, shards)
            if not near:
                return hi, [self.units[bisect_right(self.ends, c) - 1][0] for c in self.walk(hi, shards, False)]
            self.split(near[:SPLIT_UNITS])


def minimax_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text).

    Equal texts stay together; null reads as the empty text of size 1. Slots number a shard's rows from 0
    without gaps, in the order of (cell of md5(doc_id), doc_id, digest). An empty table gives no rows. With fewer
    groups than shards some shards stay empty. A repeated row keeps its own slot.
    """
    base = docs.select("doc_id", text_size("text").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), digest("text").alias("digest"))
    groups = written(base.groupBy("digest").agg(F.sum("size").alias("bytes")).repartitionByRange("digest"), "groups")  # units are read again
    _, cuts = Units(groups).solve(shards)
    removed(docs.sparkSession, groups)
    shard = F.lit(0)
    for d in cuts:
        shard = shard + F.when(F.col("digest") > d + "g", 1).otherwise(0)  # above all that begin like this
    rows = base.withColumn("shard", shard).withColumn("cell", _cell(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), SLOT_DIGITS))
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))  # at most shards x 4096 rows
    before = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "digest")) - 1
    out = rows.withColumn("own", own).join(F.broadcast(before), ["shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
