"""What text recognition returned: word confidence in bands, order of lines, choice of a pass, headings in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.functions import patterns as P
from veridex.functions.rates import fixed

LEAST_IN_BAND = 3


def mean_confidences(words: DataFrame, bands: DataFrame) -> DataFrame:
    """Mean word confidence of every band to two digits; that of all words if fewer than three lie inside the band.

    words: image_id, y0, y1, confidence (null and not a number count as 0); bands: image_id, band, y, height. The
    band is matched in the same pass that sums up all words, so an image's words are not paired with each other. An
    image without words gives null.
    """
    sure = F.when(F.isnan("confidence"), 0.0).otherwise(F.coalesce("confidence", F.lit(0.0)))
    j = bands.join(words.withColumn("_c", sure).select("image_id", "y0", "y1", "_c"), "image_id", "left")
    inside = (F.col("y0") >= F.col("y")) & (F.col("y1") <= F.col("y") + F.col("height"))
    g = j.groupBy("image_id", "band").agg(F.count("_c").alias("n"), F.sum("_c").alias("s"), F.count_if(inside).alias("n_in"), F.sum(F.when(inside, F.col("_c"))).alias("s_in"))
    use = F.col("n_in") >= LEAST_IN_BAND
    return g.select("image_id", "band", F.when(use, F.col("n_in")).otherwise(F.col("n")).alias("words"), F.when(F.col("n") > 0, fixed(F.when(use, F.col("s_in") / F.col("n_in")).otherwise(F.col("s") / F.col("n")), 2)).alias("confidence"))


def ordered_lines(lines: DataFrame) -> DataFrame:
    """Lines of every image (image_id, x0, y0, text) from top to bottom, then from the left, with their position from 0.

    White space within a line becomes one space; lines without text go.
    """
    tidy = F.trim(F.regexp_replace("text", r"\s+", " "))
    w = Window.partitionBy("image_id").orderBy("y0", "x0", "text")
    return lines.withColumn("text", tidy).filter("text <> ''").withColumn("position", F.row_number().over(w) - 1)


def pass_score(text: Column, confidence: Column) -> Column:
    """Twice the ingredient heading and .6 for a nutrition heading, length up to 1200 characters, and confidence; four digits."""
    t = F.trim(text)
    has = lambda p: F.when(t.rlike(P.java(p)), 1.0).otherwise(0.0)
    return fixed((has(P.INGREDIENT_HEADING) + has(P.NUTRITION_HEADING) * 0.3) * 2 + F.least(F.lit(1.0), F.char_length(t) / 1200.0) + confidence / 100.0, 4)


def best_passes(passes: DataFrame, most: int) -> DataFrame:
    """The best pass of every image (image_id, pass from 0, text, confidence): the first of the highest score.

    At most min(most, 4) passes count, none after one with an ingredient heading and more than 120 characters.
    """
    enough = F.trim("text").rlike(P.java(P.INGREDIENT_HEADING)) & (F.char_length(F.trim("text")) > 120)
    p = passes.filter(F.col("pass") < max(1, min(most, 4))).withColumns({"score": pass_score(F.col("text"), F.col("confidence")), "_enough": enough})
    before = Window.partitionBy("image_id").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)
    p = p.filter("pass >= 0").withColumn("_over", F.coalesce(F.bool_or("_enough").over(before), F.lit(False))).filter("not _over")
    return p.groupBy("image_id").agg(F.min_by(F.struct("pass", "score"), F.struct(-F.col("score"), "pass")).alias("b"), F.count("*").alias("passes"), F.bool_or("_enough").alias("stopped_early")).select("image_id", "b.pass", "b.score", "passes", "stopped_early")


def overlap(heading: Column, block: Column) -> Column:
    """How many of a heading's first 24 characters stand at the same place of a block, if the first ten occur in it; else 0."""
    needle, hay = F.lower(F.left(heading, F.lit(24))), F.lower(F.left(block, F.lit(120)))
    n = F.char_length(needle)
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(needle, i, F.lit(1)) == F.substr(hay, i, F.lit(1))))
    return F.when((F.char_length(heading) > 3) & F.contains(hay, F.left(needle, F.lit(10))), same).otherwise(0)


def heading_blocks(headings: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block of its image that fits each heading best, the first of equals; no block if none fits.

    headings: image_id, kind, heading; blocks: image_id, ord, text and others. Paired within an image only.
    """
    j = headings.join(blocks.select("image_id", "ord", "text"), "image_id", "left").withColumn("_score", overlap(F.col("heading"), F.col("text")))
    g = j.groupBy("image_id", "kind", "heading").agg(F.min_by(F.struct("ord", "_score"), F.struct(-F.col("_score"), "ord")).alias("b"))
    return g.select("image_id", "kind", "heading", F.when(F.col("b._score") > 0, F.col("b.ord")).alias("ord"), F.coalesce("b._score", F.lit(0)).alias("score"))


def over_limits(width: str, height: str, most_side: int, most_pixels: int) -> Column:
    """Why an image of this size is not decoded; null if it is."""
    w, h = F.coalesce(F.col(width), F.lit(0)), F.coalesce(F.col(height), F.lit(0))
    return F.when((w <= 0) | (h <= 0), "INVALID_IMAGE").when((F.greatest(w, h) > most_side) | (w.cast("bigint") * h > most_pixels), "IMAGE_TOO_LARGE")


def progress(done: Column, total: Column) -> Column:
    """Whole percent done, 0 where there is nothing to do."""
    return F.coalesce(F.floor(F.try_divide(done * 100.0, total) + 0.5).cast("int"), F.lit(0))
