"""Document fingerprints by one-permutation MinHash with optimal densification and packed low bits.

Every shingle is hashed once; the top bits choose a bin, each bin keeps its least hash. Empty bins take the
value of another bin that a fixed sequence of probes finds first filled (the same for every document). Of each
bin the low bits are stored; chance agreement of those bits is subtracted when two fingerprints are compared.

Defined cases: null reads as empty text; texts of fewer than five words are one shingle of all their words and
texts without words one shingle of their bytes, so equal texts always have equal fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridex.llm.common import Words, mapped, mix, partitions, ship, shingles

BINS = 512
BITS = 4
PER_SEGMENT = 20
_NONE = np.uint64(2**64 - 1)


def binned(hashes: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The least hash of each bin, one row per text; empty bins hold all ones."""
    out = np.full(len(counts) * bins, _NONE, np.uint64)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    at = np.repeat(np.arange(len(counts)) * bins, counts) + (hashes >> shift).astype(np.int64)
    np.minimum.at(out, at, hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    return out.reshape(len(counts), bins)


def densified(values: np.ndarray) -> np.ndarray:
    """Fill empty bins by probing: attempt a of bin i looks at the same bin in every document."""
    n, bins = values.shape
    filled = values != _NONE
    row, col = np.nonzero(~filled)
    out = values.copy()
    attempt = 0
    while len(row) and attempt < 8 * bins:
        attempt += 1
        probe = (mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x100000001B3) + np.uint64(attempt << 20)) % np.uint64(bins)).astype(np.int64)
        from_ = probe[col]
        hit = filled[row, from_]
        out[row[hit], col[hit]] = values[row[hit], from_[hit]]
        row, col = row[~hit], col[~hit]
    for step in range(1, bins):  # the few left over: the next filled bin to the right
        if not len(row):
            break
        from_ = (col + step) % bins
        hit = filled[row, from_]
        out[row[hit], col[hit]] = values[row[hit], from_[hit]]
        row, col = row[~hit], col[~hit]
    return out


def packed(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of each value, packed into bytes; bits is 1, 2, 4 or 8."""
    low = (mix(values) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    per = 8 // bits
    low = low.reshape(len(low), -1, per)
    out = np.zeros(low.shape[:2], np.uint8)
    for j in range(per):
        out |= low[:, :, j] << (bits * j)
    return out


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of two columns of packed fingerprints, without the bias of chance agreement."""
    differ = a ^ b
    same = np.zeros(len(a), np.int64)
    for j in range(8 // bits):
        same += ((differ >> (bits * j)) & ((1 << bits) - 1) == 0).sum(axis=1)
    chance = 2.0**-bits
    return np.clip((same / (a.shape[1] * 8 // bits) - chance) / (1 - chance), 0.0, 1.0)


def fingerprints_of(column: pa.Array, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    return packed(densified(binned(*shingles(Words(column)), bins)), bits)


def _stored(a: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in a], pa.binary())


def _loaded(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Add a binary column with the packed fingerprint of `text`."""
    ship(df.sparkSession)
    return mapped(df, lambda b: [_stored(fingerprints_of(b.column(text), bins, bits))], T.StructType([T.StructField(out, T.BinaryType())]), text)


def with_likeness(df: DataFrame, a: str, b: str, out: str, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Add the estimated similarity of two fingerprint columns; both must be filled."""
    ship(df.sparkSession)
    width = bins * bits // 8

    def fn(batch):
        return [pa.array(likeness(_loaded(batch.column(a), width), _loaded(batch.column(b), width), bits))]

    return mapped(df, fn, T.StructType([T.StructField(out, T.DoubleType())]), a)


def _measure(df: DataFrame, key: str) -> Column:
    """The key as what segments compare: moments as numbers, as Python and Arrow read their zones differently."""
    return F.unix_micros(F.col(key)) if isinstance(df.schema[key].dataType, T.TimestampType) else F.col(key)


def _bounds(keys: DataFrame, key: Column, segments: int) -> list:
    """Rising values of the key that cut its range into about so many equal parts; they decide balance only.

    Taken from the rows of least hash, PER_SEGMENT for each part.
    """
    some = keys.select(key.alias("k")).filter("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(PER_SEGMENT * segments)
    found = sorted(r[0] for r in some.collect())
    return found[PER_SEGMENT::PER_SEGMENT]


def _segments(bounds: list):
    """A column function: how many bounds lie below the key, plus one; 0 for null."""
    index = np.array(bounds) if bounds and isinstance(bounds[0], int) else np.array(bounds, object)

    @F.arrow_udf(T.IntegerType())
    def segment(c: pa.Array) -> pa.Array:
        null = np.asarray(c.is_null())
        values = c.drop_null()
        values = values.to_numpy(zero_copy_only=False) if pa.types.is_integer(values.type) else np.array(values.to_pylist() + [None], object)[:-1]
        out = np.zeros(len(c), np.int32)
        out[~null] = np.searchsorted(index, values, "left") + 1
        return pa.array(out)

    return segment


def with_next(df: DataFrame, keys: DataFrame, key: str, columns: dict[str, str], tie: list[str] = ()) -> DataFrame:
    """Each row gets columns of the row after it in descending order of `key`; the last gets those of the first.

    The key's range is cut into segments; a segment's first row also goes to the segment above it, so that no task
    needs more than one segment. keys: the same rows with at least `key`, cheap to read. The key may be of any
    sortable type, strings in the order of their bytes. Null keys come last; ties are ordered by `tie`, nulls first.
    """
    spark = df.sparkSession
    ship(spark)
    measure = _measure(df, key)
    segment = _segments(_bounds(keys, measure, 4 * partitions(spark)))
    firsts = sorted((r[0], r[1]) for r in keys.select(segment(measure).alias("_seg"), key).groupBy("_seg").agg(F.max(key)).collect())  # a row each segment
    if not firsts:
        return df.select("*", *[F.col(c).alias(n) for n, c in columns.items()])
    above = [firsts[(i + 1) % len(firsts)][0] for i in range(len(firsts))]
    small = spark.createDataFrame([(s, m, t) for (s, m), t in zip(firsts, above)], T.StructType([T.StructField("_seg", T.IntegerType()), T.StructField("_max", df.schema[key].dataType), T.StructField("_to", T.IntegerType())]))
    place = lambda s, g: F.struct(F.col(s).alias("_at"), F.lit(g).alias("_guest"))
    rows = df.withColumn("_seg", segment(measure)).join(F.broadcast(small), "_seg").withColumn("_place", F.explode(F.when(F.col(key).eqNullSafe(F.col("_max")), F.array(place("_seg", 0), place("_to", 1))).otherwise(F.array(place("_seg", 0)))))
    over = Window.partitionBy("_place._at").orderBy(F.col("_place._guest"), F.col(key).desc_nulls_last(), *[F.col(c) for c in tie])
    return rows.select(*df.columns, "_place", *[F.lead(c).over(over).alias(n) for n, c in columns.items()]).filter("_place._guest = 0").drop("_place")


def edited_pairs(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness to it and to the next document.

    docs: doc_id, text. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, one row per row of docs. Equal doc_ids are ordered by text; an empty table gives no rows.
    """
    own = with_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "fp", bins, bits)
    own = with_next(own, docs, "doc_id", {"next_text": "text", "next_fp": "fp"}, tie=["text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.when(half > 0, F.left("next_text", half)).otherwise(""))
    pairs = own.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    pairs = pairs.withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    width = bins * bits // 8

    def fn(b):
        a, c = _loaded(b.column("fp"), width), _loaded(b.column("next_fp"), width)
        e = fingerprints_of(b.column("edited"), bins, bits)
        return [_stored(e), pa.array(likeness(a, e, bits)), pa.array(likeness(a, c, bits))]

    extra = T.StructType([T.StructField("edited_fp", T.BinaryType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    done = mapped(pairs, fn, extra, "edited")
    return done.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")
