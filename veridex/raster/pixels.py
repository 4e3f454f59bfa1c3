"""Rasters as rows of pixels, and what windows over such rows can tell: local thresholds from running sums along rows and
columns, bands of rows by sliding sums, and regions of text by gaps and islands.

An image's pixels are dealt out by its rows and then by its columns, so that no task needs a whole image; only what
is left of it, a row of pixels or cells, is put in order as one. All sums are of whole numbers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.raster import kernels
from veridex.raster.frames import _rasters
from veridex.shipping import ship


def pixels(rasters: DataFrame, key: str = "image_id") -> DataFrame:
    """key, y, x, v (grey, 0 to 255) of every pixel of rasters (key, width, height, data)."""
    kind = rasters.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, img in zip(b.column(key), _rasters(b)):
                h, w = img.shape[:2]
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(max(w, 1)))
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * (h * w), b.column(key).type), pa.array(y), pa.array(x), pa.array(kernels.clamp(kernels.luminance(img)).ravel().astype(np.int16))], names=[key, "y", "x", "v"])

    ship(rasters.sparkSession)
    return rasters.select(key, "width", "height", "data").mapInArrow(run, f"{key} {kind}, y int, x int, v smallint")


def raster(shown: DataFrame, key: str = "image_id", value: str = "v") -> DataFrame:
    """The rasters (key, width, height, data) that rows (key, y, x, value) make: grey, opaque, in the order of rows and columns."""
    px = F.hex(F.col(value).cast("int"))
    px = F.lpad(px, 2, "0")
    rows = shown.select(key, "y", "x", F.concat(px, px, px, F.lit("FF")).alias("px"))
    lines = rows.groupBy(key, "y").agg(F.expr("listagg(px, '') WITHIN GROUP (ORDER BY x)").alias("line"), F.count("*").cast("int").alias("width"))
    g = lines.groupBy(key).agg(F.max("width").alias("width"), F.count("*").cast("int").alias("height"), F.expr("listagg(line, '') WITHIN GROUP (ORDER BY y)").alias("all"))
    return g.select(key, "width", "height", F.unhex("all").alias("data"))


def box_sums(shown: DataFrame, values: dict[str, Column], half: int, key: str = "image_id") -> DataFrame:
    """shown with, for each name, the sum of its value over the window of 2 half + 1 pixels each way, cut at the border, and n, its size.

    Along a row a running sum gives the sum from x - half to x + half as the difference of two of its values; the
    same along columns over these sums is the integral image's four corners.
    """
    names = [*values, "n"]
    part = {**values, "n": F.lit(1)}
    for across, along in (("y", "x"), ("x", "y")):
        w, whole = Window.partitionBy(key, across).orderBy(along), Window.partitionBy(key, across)
        upto = [F.sum(part[n].cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"upto_{n}") for n in names]
        shown = shown.select(*[c for c in shown.columns if c not in names], *upto)
        slid = lambda c: F.coalesce(F.lead(c, half).over(w), F.max(c).over(whole)) - F.coalesce(F.lag(c, half + 1).over(w), F.lit(0))  # noqa: B023, E731  values are none below 0
        shown = shown.withColumns({n: slid(f"upto_{n}") for n in names}).drop(*[f"upto_{n}" for n in names])
        part = {n: F.col(n) for n in names}
    return shown


def thresholded(shown: DataFrame, limit: Column) -> DataFrame:
    return shown.withColumn("v", F.when(F.col("v") > limit, 255).otherwise(0))


def adaptive_threshold(shown: DataFrame, block: int = 31, c: float = 10, key: str = "image_id") -> DataFrame:
    """Pixels above their window's mean less c are white, others black."""
    s = box_sums(shown, {"total": F.col("v")}, block // 2, key)
    return thresholded(s, F.col("total") / F.col("n") - F.lit(float(c))).select(key, "y", "x", "v")


def _local(shown: DataFrame, block: int, key: str) -> tuple[DataFrame, Column, Column]:
    s = box_sums(shown, {"total": F.col("v"), "squares": F.col("v").cast("bigint") * F.col("v")}, block // 2, key)
    mean = F.col("total") / F.col("n")
    return s, mean, F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - mean * mean))


def sauvola(shown: DataFrame, block: int = 31, k: float = 0.2, r: float = 128, key: str = "image_id") -> DataFrame:
    """Pixels above mean (1 + k (deviation / r - 1)) of their window are white."""
    s, mean, sd = _local(shown, block, key)
    return thresholded(s, mean * (1 + F.lit(k) * (sd / F.lit(float(r)) - 1))).select(key, "y", "x", "v")


def niblack(shown: DataFrame, block: int = 31, k: float = -0.2, key: str = "image_id") -> DataFrame:
    """Pixels above mean + k deviations of their window are white."""
    s, mean, sd = _local(shown, block, key)
    return thresholded(s, mean + F.lit(k) * sd).select(key, "y", "x", "v")


def roi_bands(shown: DataFrame, key: str = "image_id") -> DataFrame:
    """key, top, bottom (rows, the second not included) of the band in which rows differ most in their dark pixels.

    The band has a twentieth of the rows, at least 20; of equally uneven ones the uppermost counts. It is widened by
    a fiftieth of the rows. Where it would be under 32 rows or all of them, or the image is smaller, it is the image.
    """
    rows = shown.groupBy(key, "y").agg(F.count_if(F.col("v") < 128).alias("dark"))
    rows = rows.withColumn("h", F.count("*").over(Window.partitionBy(key)))
    band = F.greatest(F.lit(20), F.floor(F.col("h") * 0.05)).cast("int")
    run = Window.partitionBy(key).orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(key, "y", "h", band.alias("band"), F.sum("dark").over(run).alias("s"), F.sum(F.col("dark") * F.col("dark")).over(run).alias("q"))
    # the running sums above the band's first row and at its last one: a self-join at a distance that each image has for itself
    ends = rows.select(key, (F.col("y") - F.col("band")).alias("before"), "h", "band", F.col("s").alias("s2"), F.col("q").alias("q2"))
    starts = rows.select(key, F.col("y").alias("before"), F.col("s").alias("s1"), F.col("q").alias("q1"))
    j = ends.filter("before >= -1").join(starts, [key, "before"], "left").fillna(0, ["s1", "q1"])
    s, q = F.col("s2") - F.col("s1"), F.col("q2") - F.col("q1")
    best = j.groupBy(key, "h", "band").agg(F.max_by("before", F.struct((F.col("band") * q - s * s).alias("spread"), (-F.col("before")).alias("first"))).alias("before"))
    pad = F.floor(F.col("h") * 0.02 + 0.5)
    top, bottom = F.greatest(F.lit(0), F.col("before") + 1 - pad), F.least(F.col("h"), F.col("before") + 1 + F.col("band") + pad)
    whole = (bottom - top < 32) | (bottom - top >= F.col("h"))
    found = best.select(key, F.when(whole, 0).otherwise(top).cast("int").alias("top"), F.when(whole, F.col("h")).otherwise(bottom).cast("int").alias("bottom"))
    small = rows.filter("h < band").groupBy(key).agg(F.lit(0).alias("top"), F.max("h").cast("int").alias("bottom"))
    return found.unionByName(small)


def cell_edges(shown: DataFrame, cell: int, key: str = "image_id") -> DataFrame:
    """key, cy, cx, n, w: of each whole cell how many of its pixels in even rows and columns differ from the pixel after them; the image's width.

    The pixel after a row's last one is the next row's first one. Pixels are put in order once; the size of an image
    is found from its cells.
    """
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    following = F.lead("v").over(Window.partitionBy(key).orderBy("y", "x"))
    seen = shown.select(key, "y", "x", F.coalesce(following != F.col("v"), F.lit(False)).alias("differs"))
    counts = F.count_if((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0)).alias("looked_at"), F.count_if((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0) & F.col("differs")).alias("n")
    cells = seen.groupBy(key, at("y").alias("cy"), at("x").alias("cx")).agg(*counts, F.max("y").alias("y"), F.max("x").alias("x"))
    size = Window.partitionBy(key)
    cells = cells.select(key, "cy", "cx", "n", "looked_at", (F.max("y").over(size) + 1).alias("h"), (F.max("x").over(size) + 1).alias("w"))
    return cells.filter((F.col("looked_at") > 0) & (F.col("cy") < at("h")) & (F.col("cx") < at("w"))).select(key, "cy", "cx", "n", "w")


def text_regions(shown: DataFrame, cell: int = 32, most: int = 4, key: str = "image_id") -> DataFrame:
    """key, k, x, y, width, height of the bands of rows of cells that have a cell as dense in edges as the top tenth: of at least two rows each, the first `most`.

    A band is an island: the number of a row less its rank among the active rows is the same all through it. Images
    without edges, or smaller than a cell, have none.
    """
    cells = cell_edges(shown, cell, key)
    by_density, all_ = Window.partitionBy(key).orderBy("n", "cy", "cx"), Window.partitionBy(key)
    ranked = cells.withColumns({"at": F.row_number().over(by_density) - 1, "cells": F.count("*").over(all_)})
    high = F.max(F.when(F.col("at") == F.floor(F.col("cells") * 0.9), F.col("n"))).over(all_)
    active = ranked.withColumn("high", high).filter("high > 0 and n >= high").groupBy(key, "cy").agg(F.max("w").alias("w"))
    islands = active.withColumn("island", F.col("cy") - F.row_number().over(Window.partitionBy(key).orderBy("cy")))
    bands = islands.groupBy(key, "island").agg(F.min("cy").alias("first"), F.count("*").alias("rows"), F.max("w").alias("w")).filter("rows >= 2")
    bands = bands.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("first"))).filter(F.col("k") <= most)
    whole = lambda c: c.cast("int")
    return bands.select(key, "k", F.lit(0).alias("x"), whole(F.col("first") * cell).alias("y"), whole(F.col("w")).alias("width"), whole(F.col("rows") * cell).alias("height"))
