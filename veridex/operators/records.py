"""Analytics over benchmark records: one row per engine and frame or image, misses included.

Records have id, session_id, engine, frame_number, ts, test_type, classification, detection_time_ms, angle, success,
image_id, variant and barcode_value. Order of arrival is the order of id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.functions.rates import floor_rank, rate, rate_or_zero, rounded

LATENCY_WINDOW = 2000
_SALTS = 64


def hit() -> Column:
    return F.col("classification") != "miss"


def is_class(name: str) -> Column:
    return F.col("classification") == name


def last_latencies(records: DataFrame, keep: int = LATENCY_WINDOW) -> DataFrame:
    """engine, detection_time_ms, id of each engine's last `keep` latencies.

    Salted in two rounds: few engines hold all rows, so each salt first keeps its own last ones.
    """
    some = records.filter("detection_time_ms is not null").select("engine", "id", "detection_time_ms", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).alias("salt"))
    for keys in (["engine", "salt"], ["engine"]):
        last = Window.partitionBy(*keys).orderBy(F.col("id").desc())
        some = some.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= keep).drop("_n")
    return some.drop("salt")


def counts() -> list[Column]:
    live = F.col("test_type") != "image"
    return [
        F.count("*").alias("total_frames"), F.count_if(hit()).alias("detections"), F.count_if(is_class("correct")).alias("correct"), F.count_if(is_class("incorrect")).alias("incorrect"),
        F.count_if(live & hit()).alias("live_detections"), F.count_if(live & is_class("correct")).alias("live_correct"),
        F.count_if(~live & hit()).alias("image_detections"), F.count_if(~live & is_class("correct")).alias("image_correct"), F.min("id").alias("first_id"),
    ]


def engine_rankings(records: DataFrame) -> DataFrame:
    """Counts, rates (null without detections), latency figures over the last 2000, and the rank by live accuracy."""
    totals = records.groupBy("engine").agg(*counts())
    lat = last_latencies(records).groupBy("engine").agg(
        rounded(F.sum("detection_time_ms") / F.count("*")).alias("avg_latency"), F.min("detection_time_ms").alias("min_latency"),
        F.max("detection_time_ms").alias("max_latency"), floor_rank(F.collect_list("detection_time_ms"), 50).alias("median_latency"),
    )
    order = Window.orderBy(rate_or_zero(F.col("live_correct"), F.col("live_detections")).desc(), "first_id")  # one row an engine
    return totals.join(lat, "engine", "left").select(
        "engine", "total_frames", "detections", "correct", "incorrect",
        rate(F.col("detections"), F.col("total_frames"), 100).alias("detection_rate"), rate(F.col("correct"), F.col("detections"), 100).alias("accuracy"),
        rate(F.col("incorrect"), F.col("detections"), 100).alias("false_positive_rate"), "avg_latency", "min_latency", "max_latency", "median_latency",
        F.row_number().over(order).alias("rank"),
    )


def ranking_sets(records: DataFrame) -> DataFrame:
    """The overall, live and image rankings in one pass over grouping sets."""
    r = records.withColumn("is_image", F.col("test_type") == "image")
    g = r.groupingSets([["engine"], ["engine", "is_image"]], "engine", "is_image")
    return g.agg(F.count("*").alias("total_frames"), F.count_if(hit()).alias("detections"), F.count_if(is_class("correct")).alias("correct"))


def angle_matrix(records: DataFrame) -> DataFrame:
    """Long form: a check mark where more than half of an engine's records at an angle are correct."""
    g = records.filter("angle is not null").groupBy("engine", "angle").agg(F.count_if(is_class("correct")).alias("correct"), F.count("*").alias("total"))
    return g.withColumn("cell", F.when(F.col("correct") * 2 > F.col("total"), "✓").otherwise("✗"))


def angle_grid(records: DataFrame, angles: list[int]) -> DataFrame:
    """Wide form over a fixed list of angles; --- where there is no record."""
    wide = angle_matrix(records).groupBy("engine").pivot("angle", angles).agg(F.first("cell"))
    return wide.select("engine", *[F.coalesce(F.col(str(a)), F.lit("---")).alias(f"angle_{a}") for a in angles])


def image_summary(records: DataFrame, variant: str | None = None) -> DataFrame:
    r = records.filter("test_type = 'image'")
    r = r.filter(F.col("variant") == variant) if variant else r
    g = r.groupBy("engine").agg(F.count("*").alias("total"), F.count_if(hit()).alias("detected"), F.count_if(is_class("correct")).alias("correct"), F.sum(F.when(hit(), F.col("detection_time_ms"))).alias("ms"))
    return g.select("engine", "total", rate_or_zero(F.col("detected"), F.col("total"), 100).alias("detection_rate"), rate(F.col("correct"), F.col("detected"), 100).alias("accuracy"), rounded(F.try_divide(F.col("ms"), F.col("detected"))).alias("avg_latency"))


def sessions(records: DataFrame) -> DataFrame:
    """When each session began and ended, and how many frames of it each kind of test saw; by the session's own id, not by gaps."""
    kinds = ("live", "image", "angle")
    return records.groupBy("session_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("frames"), *[F.count_if(F.col("test_type") == k).alias(f"{k}_frames") for k in kinds])


def hits_by_image(records: DataFrame) -> DataFrame:
    """Engines that found something in an image variant, in the order of their first hit."""
    first = records.filter(hit()).groupBy("image_id", "variant", "engine").agg(F.min("id").alias("id"))
    return first.groupBy("image_id", "variant").agg(F.array_sort(F.collect_list(F.struct("id", "engine"))).alias("e")).select("image_id", "variant", F.array_join(F.col("e.engine"), ",").alias("engines"))


def missed_images(records: DataFrame) -> DataFrame:
    return records.groupBy("image_id").agg(F.bool_and(~hit()).alias("m")).filter("m").select("image_id")


def partial_hit_images(records: DataFrame) -> DataFrame:
    """Nothing found in the original (or no original), but in some variant."""
    original = F.bool_and(F.when(F.col("variant") == "original", ~hit()))
    return records.groupBy("image_id").agg(F.coalesce(original, F.lit(True)).alias("m"), F.bool_or(hit()).alias("h")).filter("m and h").select("image_id")


def without(records: DataFrame, ids: DataFrame, key: str = "image_id") -> DataFrame:
    """Delete rows by key (retry sets, cascades)."""
    return records.join(ids, key, "left_anti")


def first_correct_engine(records: DataFrame) -> DataFrame:
    g = records.filter(hit()).groupBy("session_id", "engine").agg(F.count_if(is_class("correct")).alias("c"), F.max_by("detection_time_ms", "id").alias("ms"))
    return g.filter("c > 0").groupBy("session_id").agg(F.min_by("engine", F.struct("ms", "engine")).alias("engine"), F.min("ms").alias("latency"))


def latest_detection(records: DataFrame) -> DataFrame:
    return records.filter(hit()).groupBy("session_id", "engine").agg(F.max_by("barcode_value", "id").alias("last_value"), F.max_by("detection_time_ms", "id").alias("last_latency"))


def without_repeats(records: DataFrame) -> DataFrame:
    """Drop detections that repeat the engine's previous value in the session; a miss in between resets it.

    A miss has no value, so the value of the row before tells both cases apart.
    """
    w = Window.partitionBy("session_id", "engine").orderBy("id")
    prev = F.lag("barcode_value").over(w)
    return records.withColumn("_prev", prev).filter("barcode_value is null or _prev is null or barcode_value <> _prev").drop("_prev")


def rolling_latency(records: DataFrame, rows: int = LATENCY_WINDOW) -> DataFrame:
    """Sum and count of the last `rows` latencies of a session's engine at every record."""
    w = Window.partitionBy("session_id", "engine").orderBy("id").rowsBetween(-(rows - 1), 0)
    return records.filter("detection_time_ms is not null").select("id", "session_id", "engine", F.sum("detection_time_ms").over(w).alias("sum_ms"), F.count("*").over(w).alias("n"))


def best_so_far(records: DataFrame) -> DataFrame:
    """Whether a latency beats all earlier ones of its session and engine."""
    w = Window.partitionBy("session_id", "engine").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    r = records.filter("detection_time_ms is not null")
    return r.select("id", (F.col("detection_time_ms") > F.coalesce(F.max("detection_time_ms").over(w), F.lit(-1))).alias("selected"))


def engine_metrics(records: DataFrame) -> DataFrame:
    g = records.groupBy("engine").agg(F.count("*").alias("attempts"), F.count_if(hit()).alias("detections"), F.coalesce(F.sum("detection_time_ms"), F.lit(0)).alias("total_ms"))
    return g.select("*", rate_or_zero(F.col("detections"), F.col("attempts")).alias("ratio"), rate_or_zero(F.col("total_ms"), F.col("attempts")).alias("avg_ms"))


def histogram(records: DataFrame) -> DataFrame:
    """count, sum, min, max, p50, p95 of latencies per engine by floor rank; zeros if there are none.

    Rows are first counted by value, so that state grows with the number of different latencies only.
    """
    c = records.groupBy("engine", "detection_time_ms").agg(F.count("detection_time_ms").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("engine").orderBy(F.col("detection_time_ms").asc_nulls_first()))
    c = c.select("engine", F.col("detection_time_ms").alias("v"), "n", upto.alias("upto"), F.sum("n").over(Window.partitionBy("engine")).alias("total"))
    at = lambda percent: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.col("total") * percent / F.lit(100.0))), F.col("v")))
    zero = lambda x, name: F.coalesce(x, F.lit(0).cast("bigint")).alias(name)
    return c.groupBy("engine").agg(F.sum("n").alias("n"), zero(F.sum(F.col("v") * F.col("n")), "sum_ms"), zero(F.min("v"), "min_ms"), zero(F.max("v"), "max_ms"), zero(at(50), "p50"), zero(at(95), "p95"))


def weighted_floor_rank(records: DataFrame, percent: int) -> DataFrame:
    """The same percentile from counts of distinct values: state grows with values, not with rows."""
    c = records.filter("detection_time_ms is not null").groupBy("engine", "detection_time_ms").agg(F.count("*").alias("n"))
    w = Window.partitionBy("engine").orderBy("detection_time_ms")
    c = c.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("engine")))
    at = F.least(F.col("total") - 1, F.floor(F.col("total") * percent / F.lit(100.0)))
    return c.filter(F.col("upto") > at).groupBy("engine").agg(F.min("detection_time_ms").alias("value"))


def derived_rates(records: DataFrame) -> DataFrame:
    """Service rates over all records, 0 where nothing was counted."""
    g = records.agg(F.count("*").alias("n"), F.count_if(hit()).alias("d"), F.count_if(is_class("correct")).alias("c"), F.count_if(is_class("incorrect")).alias("i"))
    return g.select(rate_or_zero(F.col("d"), F.col("n")).alias("detection_rate"), rate_or_zero(F.col("c"), F.col("d")).alias("success_rate"), rate_or_zero(F.col("i"), F.col("n")).alias("error_rate"))


def condition(records: DataFrame) -> DataFrame:
    label = F.when(F.col("variant") == "original", F.col("test_type")).otherwise(F.concat_ws("/", "test_type", "variant"))
    return records.groupBy(label.alias("test_condition")).agg(F.count("*").alias("n"))


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new replace rows of old with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def first_scale_hit(records: DataFrame, scales: list[int]) -> DataFrame:
    """Sweep of images, variants and engines over scales; the first scale in order that gives a hit.

    Stands for the image sweep: the decoder's result at a scale is a fixed function of the record here.
    """
    grid = records.select("id", "image_id", "variant", "engine", F.posexplode(F.array(*[F.lit(s) for s in scales])).alias("ord", "scale"))
    hit = (F.col("id") + F.col("scale")) % 3 == 0
    return grid.filter(hit).groupBy("id", "image_id", "variant", "engine").agg(F.min_by("scale", "ord").alias("scale"))


def labelled(code: Column, labels: dict[str, str], otherwise: Column) -> Column:
    """What is shown for a code; `otherwise` for one without a label."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code), otherwise)


def race_states(frames: DataFrame) -> DataFrame:
    """status (found, miss, failed) and last value of every session's engine after its last frame that is no repeat.

    frames: session_id, engine, frame_number, value, failed. A repeat of the last value changes nothing; a failed frame
    keeps the last value, a miss forgets it.
    """
    before = Window.partitionBy("session_id", "engine").orderBy("frame_number").rowsBetween(Window.unboundedPreceding, -1)
    told = F.struct(F.when(~F.col("failed"), F.col("value")).alias("value"))
    last = F.last(F.when(~F.col("failed"), told), ignorenulls=True).over(before)["value"]
    f = frames.withColumn("_last", last).filter(~F.coalesce(F.col("value") == F.col("_last"), F.lit(False)))
    status = F.when(F.col("failed"), "failed").when(F.col("value").isNotNull(), "found").otherwise("miss")
    kept = F.when(F.col("failed"), F.col("_last")).otherwise(F.col("value"))
    return f.groupBy("session_id", "engine").agg(F.max_by(F.struct(status.alias("status"), kept.alias("last_value")), "frame_number").alias("s")).select("session_id", "engine", "s.*")
