"""Raster kernels over DataFrames: rows of (width int, height int, data binary), pixels stay in binary columns."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.functions.net import let
from veridex.raster import kernels
from veridex.shipping import ship

RASTER = "width int, height int, data binary"
#: External decoders by name: raster -> list of (value, format). Registered by the caller; run where the pixels are.
DECODERS: dict = {}


#: Images that a step builds at once, so that its memory doesn't grow with the rows of a batch.
AT_ONCE = 64
#: Bytes of rasters that make a batch; as rows come one by one, each would cost a batch of its own.
HELD_BYTES = 1 << 20


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _cut(batches, rows: int = AT_ONCE):
    """The batches in slices of so many rows; a slice copies nothing."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _rasters(batch: pa.RecordBatch):
    for w, h, d in zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), batch.column("data")):
        yield np.frombuffer(d.as_buffer(), np.uint8).reshape(h, w, 4)


def with_variants(rasters: DataFrame, names: list[str], key: str = "image_id") -> DataFrame:
    """One row per image and variant; variants are held until they make a megabyte."""
    kind = rasters.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for k, img in zip(b.column(key).to_pylist(), _rasters(b)):
                for n in names:
                    out = kernels.variant(img, n)
                    rows.append((k, n, out.shape[1], out.shape[0], out.tobytes()))
                    size += out.nbytes
                    if size >= HELD_BYTES:
                        yield _batch(rows, [b.column(key).type, pa.string(), pa.int32(), pa.int32(), pa.binary()], [key, "variant", "width", "height", "data"])
                        rows, size = [], 0
            if rows:
                yield _batch(rows, [b.column(key).type, pa.string(), pa.int32(), pa.int32(), pa.binary()], [key, "variant", "width", "height", "data"])

    ship(rasters.sparkSession)
    return rasters.select(key, "width", "height", "data").mapInArrow(run, f"{key} {kind}, variant string, {RASTER}")


#: Digests of pixels: how each is worked out, and the types of its column.
DIGESTS = {"sha256": (lambda data: hashlib.sha256(data).hexdigest(), "string", pa.string()), "crc32": (zlib.crc32, "bigint", pa.int64())}


def variant_digests(rasters: DataFrame, names: list[str], digest: str, key: str = "image_id") -> DataFrame:
    """One row per image and variant: its size and the digest of its pixels, which stay where they are made."""
    kind = rasters.schema[key].dataType.simpleString()
    of, column, arrow = DIGESTS[digest]

    def run(batches):
        for b in _cut(batches):
            rows = [(k, n, out.shape[1], out.shape[0], of(np.ascontiguousarray(out))) for k, img in zip(b.column(key).to_pylist(), _rasters(b)) for n in names for out in [kernels.variant(img, n)]]
            if rows:
                yield _batch(rows, [b.column(key).type, pa.string(), pa.int32(), pa.int32(), arrow], [key, "variant", "width", "height", digest])

    ship(rasters.sparkSession)
    return rasters.select(key, "width", "height", "data").mapInArrow(run, f"{key} {kind}, variant string, width int, height int, {digest} {column}")


def with_quality(rasters: DataFrame, key: str = "image_id") -> DataFrame:
    kind = rasters.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            cols = list(zip(*(kernels.quality(i) for i in _rasters(b)))) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(cols[0], pa.string()), *[pa.array(c, pa.float64()) for c in cols[1:5]], pa.array(cols[5], pa.list_(pa.string()))], names=[key, "quality", "score", "brightness", "sharpness", "overexposure", "reasons"])

    ship(rasters.sparkSession)
    return rasters.select(key, "width", "height", "data").mapInArrow(run, f"{key} {kind}, quality string, score double, brightness double, sharpness double, overexposure double, reasons array<string>")


def observations(rasters: DataFrame, decoders: dict | None = None, key: str = "image_id") -> DataFrame:
    """Decode every raster with every decoder; a decoder that fails gives a row with its error instead of a value."""
    decoders = decoders if decoders is not None else DECODERS
    kind = rasters.schema[key].dataType.simpleString()

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for k, w, h, d in f[[key, "width", "height", "data"]].itertuples(index=False):
                img = np.frombuffer(d, np.uint8).reshape(h, w, 4)
                for name, decode in decoders.items():
                    try:
                        rows += [(k, name, v, fm, None) for v, fm in decode(img)]
                    except Exception as e:  # a decoder is foreign code; its failure is a result
                        rows.append((k, name, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=[key, "engine", "value", "format", "error"])

    ship(rasters.sparkSession)
    return rasters.mapInPandas(run, f"{key} {kind}, engine string, value string, format string, error string")


def levels(rasters: DataFrame, key: str = "image_id") -> DataFrame:
    """key, t, n: how many pixels of a raster have each grey level; levels without pixels don't come out."""
    kind = rasters.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k, img in zip(b.column(key), _rasters(b)):
                n = np.bincount(kernels.clamp(kernels.luminance(img)).ravel(), minlength=256)
                t = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(t), b.column(key).type), pa.array(t.astype(np.int32)), pa.array(n[t])], names=[key, "t", "n"])

    ship(rasters.sparkSession)
    return rasters.select(key, "width", "height", "data").mapInArrow(run, f"{key} {kind}, t int, n bigint")


def otsu_levels(rasters: DataFrame, key: str = "image_id") -> DataFrame:
    """The threshold of each raster in SQL over its counts of levels: running sums, the best between-class variance."""
    from pyspark.sql import Window

    hist = levels(rasters, key)
    run = Window.partitionBy(key).orderBy("t")
    whole = Window.partitionBy(key)
    h = hist.select(key, "t", F.sum("n").over(run).alias("b"), F.sum(F.col("t") * F.col("n")).over(run).alias("m"), F.sum("n").over(whole).alias("all"), F.sum(F.col("t") * F.col("n")).over(whole).alias("mass"))
    f = F.col("all") - F.col("b")
    between = F.when(f > 0, F.col("b") * f * F.pow(F.col("m") / F.col("b") - (F.col("mass") - F.col("m")) / f, 2)).otherwise(0)
    best = h.select(key, "t", between.alias("v")).groupBy(key).agg(F.max(F.struct("v", (-F.col("t")).alias("t"))).alias("x"))
    return best.select(key, F.when(F.col("x.v") > 0, -F.col("x.t")).otherwise(127).cast("int").alias("threshold"))


def grey_from_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", side: int = 8, scale: int = 8) -> DataFrame:
    """Test rasters: a vector's values as grey cells of scale x scale pixels.

    Made by expressions, so that the step over the rasters is the only one for which executors need Python.
    """
    ship(vectors.sparkSession)
    v = F.col(column)
    line = side * scale * 8  # hexadecimal digits of a row of pixels
    pixel = F.transform(v, lambda x: F.lpad(F.hex(F.floor(F.abs(x.cast("double")) * 255) % 256), 2, "0"))
    cells = F.array_join(F.transform(pixel, lambda p: F.repeat(F.concat(p, p, p, F.lit("FF")), scale)), "")
    data = F.unhex(let(cells, lambda c: F.concat(*[F.repeat(F.substr(c, F.lit(k * line + 1), F.lit(line)), scale) for k in range(side)])))
    full = (F.size(v) == side * side) & ~F.exists(v, lambda x: x.isNull())
    wrong = F.raise_error(F.concat(F.lit("a vector of "), F.coalesce(F.size(F.array_compact(v)), F.lit(0)), F.lit(f" values doesn't fill {side} x {side} cells"))).cast("binary")
    n = F.lit(side * scale)
    return vectors.select(F.col(key).alias("image_id"), n.alias("width"), n.alias("height"), F.when(full, data).otherwise(wrong).alias("data"))
