"""Shared helpers: shipping the code, shared folders, and vectorised words and shingles."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from veridex import shipping

SHINGLE_WORDS = 5
SLICE_BYTES = 1 << 20


# --- session ---------------------------------------------------------------------------------


def ship(spark: SparkSession) -> None:
    """Send the library to the executors, and keep batches of texts small for the rest of the session."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default suits narrow rows
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    shipping.ship(spark)


#: Names of the folders that this process has made.
_made: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    folder = f"{name}-{uuid.uuid4().hex}"
    _made.add(folder)
    return f"{shipping.shared_dir(spark)}/veridex/{folder}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; lost executors don't lose it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, df: DataFrame | None) -> None:
    """Delete the tables made by written() that df is read from, once no later plan reads them; others stay."""
    jvm = spark._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if df is not None else ():
        if parent.rpartition("/veridex/")[2] in _made:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# --- Arrow -----------------------------------------------------------------------------------


def released() -> None:
    """Give freed memory back to the system, where its library can: a Python worker lives on, and other stages need it."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], *columns: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named string columns hold about `most` bytes; a longer text stays whole. Memory is released at the end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            size += np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False), np.int64)
        group = np.maximum(np.cumsum(size) - size, 0) // most
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield batch.slice(a, b - a)
    released()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null reads as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    bufs = column.buffers()
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(bufs[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column from concatenated values (any dtype) and the number of values of each row."""
    off = np.concatenate([[0], np.cumsum(lengths * values.dtype.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(values))])


def lists(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)


# --- words and shingles ----------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that belong to words: ASCII letters and digits, and everything beyond ASCII.
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.arange(256, dtype=np.uint64) << np.uint64(32))
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 18)
        inv = np.uint64(pow(int(_ODD), -1, 1 << 64))
        with np.errstate(over="ignore"):
            made = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, x, np.uint64)]), dtype=np.uint64) for x in (_ODD, inv)]
        if m > 1 << 22:
            return made[0][:n], made[1][:n]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of a column of texts, lower-cased unless told; runs of word bytes, or of those of another table. All arrays are over words of all texts.

    hash: 64 bits. start, end: byte positions in `data`. first: index of each text's first word, and the total.
    """

    def __init__(self, column: pa.Array, lower: bool = True, inside: np.ndarray = _WORD):
        self.data, self.off = raw(pc.utf8_lower(column) if lower else column)
        data, n = self.data, len(self.data)
        self.is_word = inside = inside[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = True, True
            np.logical_not(inside[:-1], out=before[1:])
            np.logical_not(inside[1:], out=after[:-1])
            inner = self.off[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            before[inner] = True
            after[inner - 1] = True
        self.start = np.flatnonzero(inside & before)
        self.end = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.power, self.inverse = _power(n + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[data] * self.power[:n], out=self.sums[1:])
        self.hash = self.span(self.start, self.end)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes give equal hashes."""
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(w: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words, and how many each text has.

    A shorter text is one shingle of all its words, one without words is one shingle of all its bytes.
    """
    n = w.counts
    h = w.hash
    total = len(h)
    by = np.uint64(0xA0761D6478BD642F)
    with np.errstate(over="ignore"):
        run = np.zeros(total + 1, np.uint64)
        m = max(0, total - size + 1)
        for j in range(size):
            run[:m] = run[:m] * by + h[j : j + m]
    have = np.maximum(n - size + 1, 1)
    last = np.cumsum(have)
    owner = np.repeat(np.arange(len(n)), have)
    at = np.arange(len(owner)) - (last - have)[owner] + w.first[:-1][owner]
    out = run[np.minimum(at, total)]
    for i in np.flatnonzero(n < size).tolist():
        acc = int(n[i])
        for x in h[w.first[i] : w.first[i + 1]].tolist() or [int(w.span(w.off[i : i + 1], w.off[i + 1 : i + 2])[0])]:
            acc = (acc * int(by) + x) % (1 << 64)
        out[last[i] - 1] = acc
    return mix(out), have


def mapped(df: DataFrame, fn, extra: StructType, *texts: str) -> DataFrame:
    """df with the columns that fn(batch) makes; a column of the same name is replaced."""
    new = {n.lower() for n in extra.names}
    df = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in new])
    schema = StructType(df.schema.fields + extra.fields)
    names = schema.names

    def run(batches):
        for b in slices(batches, *texts):
            yield pa.RecordBatch.from_arrays(list(b.columns) + list(fn(b)), names=names)

    return df.mapInArrow(run, schema)


def kept_rows(df: DataFrame, judge, condition: str, made: list[str]) -> DataFrame:
    """The rows of df for which judge(df) fulfils the condition, with df's own columns, even those named as judge's."""
    names = {n.lower() for n in made}
    aside = {c: f"_own_{c}" for c in df.columns if c.lower() in names}
    out = judge(df.withColumnsRenamed(aside)).filter(condition)
    return out.select(*[(out[f"`{aside[c]}`"].alias(c) if c in aside else out[f"`{c}`"]) for c in df.columns])
