"""Queries over benchmark records, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridex import dims
from veridex.functions.rates import millis_text, percent_text, rate
from veridex.operators import records as R
from veridex.plans.registry import query
from veridex.sources.views import view

V = ("bench_records",)
_HIT = "classification <> 'miss'"


def _bench(spark, sf_dir):
    return view(spark, sf_dir, "bench_records")


@query(
    f"""WITH t AS (SELECT engine, count(*) AS total_frames, count_if({_HIT}) AS detections, count_if(classification = 'correct') AS correct, count_if(classification = 'incorrect') AS incorrect,
  count_if({_HIT} AND test_type <> 'image') AS ld, count_if(classification = 'correct' AND test_type <> 'image') AS lc, min(id) AS first_id FROM bench_records GROUP BY engine),
l AS (SELECT * FROM (SELECT engine, detection_time_ms, row_number() OVER (PARTITION BY engine ORDER BY id DESC) AS k FROM bench_records WHERE detection_time_ms IS NOT NULL) WHERE k <= 2000),
m AS (SELECT engine, CAST(floor(sum(detection_time_ms) / count(*) + 0.5) AS BIGINT) AS avg_latency, min(detection_time_ms) AS min_latency, max(detection_time_ms) AS max_latency,
  list_sort(list(detection_time_ms))[CAST(least(count(*) - 1, floor(0.5 * count(*))) AS BIGINT) + 1] AS median_latency FROM l GROUP BY engine)
SELECT engine, total_frames, detections, correct, incorrect, detections * 100.0 / total_frames AS detection_rate, CASE WHEN detections > 0 THEN correct * 100.0 / detections END AS accuracy,
  CASE WHEN detections > 0 THEN incorrect * 100.0 / detections END AS false_positive_rate, avg_latency, min_latency, max_latency, median_latency,
  row_number() OVER (ORDER BY CASE WHEN ld > 0 THEN CAST(lc AS DOUBLE) / ld ELSE 0 END DESC, first_id) AS rank FROM t LEFT JOIN m USING (engine)""",
    V,
)
def engine_rankings(spark, sf_dir):
    return R.engine_rankings(_bench(spark, sf_dir))


@query(f"SELECT engine, test_type = 'image' AS is_image, count(*) AS total_frames, count_if({_HIT}) AS detections, count_if(classification = 'correct') AS correct FROM bench_records GROUP BY GROUPING SETS ((engine), (engine, test_type = 'image'))", V)
def ranking_grouping_sets(spark, sf_dir):
    return R.ranking_sets(_bench(spark, sf_dir))


@query("SELECT engine, angle, count_if(classification = 'correct') AS correct, count(*) AS total, CASE WHEN count_if(classification = 'correct') * 2 > count(*) THEN '✓' ELSE '✗' END AS cell FROM bench_records WHERE angle IS NOT NULL GROUP BY ALL", V)
def angle_matrix(spark, sf_dir):
    return R.angle_matrix(_bench(spark, sf_dir))


@query(
    "WITH c AS (SELECT engine, angle, CASE WHEN count_if(classification = 'correct') * 2 > count(*) THEN '✓' ELSE '✗' END AS cell FROM bench_records WHERE angle IS NOT NULL GROUP BY ALL) SELECT engine, "
    + ", ".join(f"coalesce(max(cell) FILTER (angle = {a}), '---') AS angle_{a}" for a in dims.ANGLES)
    + " FROM c GROUP BY engine",
    V,
)
def angle_grid(spark, sf_dir):
    return R.angle_grid(_bench(spark, sf_dir), dims.ANGLES)


@query(
    f"""SELECT engine, count(*) AS total, count_if({_HIT}) * 100.0 / count(*) AS detection_rate, CASE WHEN count_if({_HIT}) > 0 THEN count_if(classification = 'correct') * 100.0 / count_if({_HIT}) END AS accuracy,
  CAST(floor(sum(detection_time_ms) FILTER ({_HIT}) / nullif(count_if({_HIT}), 0) + 0.5) AS BIGINT) AS avg_latency FROM bench_records WHERE test_type = 'image' GROUP BY engine""",
    V,
)
def image_summary(spark, sf_dir):
    return R.image_summary(_bench(spark, sf_dir))


@query(f"WITH f AS (SELECT image_id, variant, engine, min(id) AS id FROM bench_records WHERE {_HIT} GROUP BY ALL) SELECT image_id, variant, string_agg(engine, ',' ORDER BY id) AS engines FROM f GROUP BY ALL", V)
def hits_by_image(spark, sf_dir):
    return R.hits_by_image(_bench(spark, sf_dir))


@query("SELECT image_id FROM bench_records GROUP BY 1 HAVING bool_and(classification = 'miss')", V)
def missed_images(spark, sf_dir):
    return R.missed_images(_bench(spark, sf_dir))


@query(f"SELECT image_id FROM bench_records GROUP BY 1 HAVING coalesce(bool_and(classification = 'miss') FILTER (variant = 'original'), true) AND bool_or({_HIT})", V)
def partial_hit_images(spark, sf_dir):
    return R.partial_hit_images(_bench(spark, sf_dir))


@query("SELECT id, image_id, engine FROM bench_records WHERE image_id NOT IN (SELECT image_id FROM bench_records GROUP BY 1 HAVING bool_and(classification = 'miss'))", V)
def retry_anti_delete(spark, sf_dir):
    b = _bench(spark, sf_dir)
    return R.without(b.select("id", "image_id", "engine"), R.missed_images(b))


@query(
    f"""WITH g AS (SELECT session_id, engine, count_if(classification = 'correct') AS c, arg_max(detection_time_ms, id) AS ms FROM bench_records WHERE {_HIT} GROUP BY ALL)
SELECT session_id, arg_min(engine, (ms, engine)) AS engine, min(ms) AS latency FROM g WHERE c > 0 GROUP BY session_id""",
    V,
)
def first_correct_engine(spark, sf_dir):
    return R.first_correct_engine(_bench(spark, sf_dir))


@query(f"SELECT session_id, engine, arg_max(barcode_value, id) AS last_value, arg_max(detection_time_ms, id) AS last_latency FROM bench_records WHERE {_HIT} GROUP BY ALL", V)
def latest_detection(spark, sf_dir):
    return R.latest_detection(_bench(spark, sf_dir))


@query("SELECT id, barcode_value FROM (SELECT *, lag(barcode_value) OVER (PARTITION BY session_id, engine ORDER BY id) AS p FROM bench_records) WHERE barcode_value IS NULL OR p IS NULL OR barcode_value <> p", V)
def dedupe_consecutive(spark, sf_dir):
    return R.without_repeats(_bench(spark, sf_dir)).select("id", "barcode_value")


@query("SELECT id, session_id, engine, CAST(sum(detection_time_ms) OVER w AS BIGINT) AS sum_ms, count(*) OVER w AS n FROM bench_records WHERE detection_time_ms IS NOT NULL WINDOW w AS (PARTITION BY session_id, engine ORDER BY id ROWS BETWEEN 1999 PRECEDING AND CURRENT ROW)", V)
def latency_window_2000(spark, sf_dir):
    return R.rolling_latency(_bench(spark, sf_dir))


@query("SELECT id, detection_time_ms > coalesce(max(detection_time_ms) OVER (PARTITION BY session_id, engine ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS selected FROM bench_records WHERE detection_time_ms IS NOT NULL", V)
def best_so_far(spark, sf_dir):
    return R.best_so_far(_bench(spark, sf_dir))


@query(f"SELECT engine, count(*) AS attempts, count_if({_HIT}) AS detections, CAST(coalesce(sum(detection_time_ms), 0) AS BIGINT) AS total_ms, CAST(count_if({_HIT}) AS DOUBLE) / count(*) AS ratio, CAST(coalesce(sum(detection_time_ms), 0) AS DOUBLE) / count(*) AS avg_ms FROM bench_records GROUP BY engine", V)
def engine_metrics(spark, sf_dir):
    return R.engine_metrics(_bench(spark, sf_dir))


_RANK = "list_sort(list(detection_time_ms) FILTER (detection_time_ms IS NOT NULL))[CAST(least(count(detection_time_ms) - 1, floor({} * count(detection_time_ms))) AS BIGINT) + 1]"


@query(f"SELECT engine, count(detection_time_ms) AS n, CAST(coalesce(sum(detection_time_ms), 0) AS BIGINT) AS sum_ms, coalesce(min(detection_time_ms), 0) AS min_ms, coalesce(max(detection_time_ms), 0) AS max_ms, coalesce({_RANK.format(0.5)}, 0) AS p50, coalesce({_RANK.format(0.95)}, 0) AS p95 FROM bench_records GROUP BY engine", V)
def histogram_snapshot(spark, sf_dir):
    return R.histogram(_bench(spark, sf_dir))


@query(f"SELECT engine, {_RANK.format(0.9)} AS value FROM bench_records WHERE detection_time_ms IS NOT NULL GROUP BY engine", V)
def percentile_from_counts(spark, sf_dir):
    return R.weighted_floor_rank(_bench(spark, sf_dir), 90)


@query(f"SELECT CAST(count_if({_HIT}) AS DOUBLE) / count(*) AS detection_rate, CAST(count_if(classification = 'correct') AS DOUBLE) / count_if({_HIT}) AS success_rate, CAST(count_if(classification = 'incorrect') AS DOUBLE) / count(*) AS error_rate FROM bench_records", V)
def derived_rates(spark, sf_dir):
    return R.derived_rates(_bench(spark, sf_dir))


@query("SELECT variant, count(*) AS n FROM bench_records GROUP BY variant", V)
def variant_usage(spark, sf_dir):
    return _bench(spark, sf_dir).groupBy("variant").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN variant = 'original' THEN test_type ELSE test_type || '/' || variant END AS test_condition, count(*) AS n FROM bench_records GROUP BY 1", V)
def condition_labels(spark, sf_dir):
    return R.condition(_bench(spark, sf_dir))


@query(
    """SELECT engine, CAST(floor(count_if(success) * 100.0 / count(*) + 0.5) AS BIGINT) || '%' AS accuracy_text, coalesce(CAST(min(detection_time_ms) FILTER (classification = 'miss') AS STRING) || ' ms', '---') AS miss_text,
  CAST(max(detection_time_ms) AS STRING) || ' ms' AS worst_text FROM bench_records GROUP BY engine""",
    V,
)
def display_texts(spark, sf_dir):
    g = _bench(spark, sf_dir).groupBy("engine").agg(F.count_if("success").alias("s"), F.count("*").alias("n"), F.min(F.when(~R.hit(), F.col("detection_time_ms"))).alias("m"), F.max("detection_time_ms").alias("w"))
    return g.select("engine", percent_text(rate(F.col("s"), F.col("n"), 100)).alias("accuracy_text"), millis_text(F.col("m")).alias("miss_text"), millis_text(F.col("w")).alias("worst_text"))


@query(
    """WITH a AS (SELECT DISTINCT engine, variant FROM bench_records WHERE test_type = 'image'), b AS (SELECT DISTINCT engine, variant FROM bench_records WHERE success AND angle > 45)
SELECT 'union' AS op, engine, variant FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', engine, variant FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', engine, variant FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    V,
)
def set_ops(spark, sf_dir):
    b = _bench(spark, sf_dir)
    x = b.filter("test_type = 'image'").select("engine", "variant").distinct()
    y = b.filter("success and angle > 45").select("engine", "variant").distinct()
    parts = {"union": x.union(y).distinct(), "intersect": x.intersect(y), "except": x.subtract(y)}
    out = [d.select(F.lit(n).alias("op"), "engine", "variant") for n, d in parts.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query(
    """WITH s AS (SELECT * FROM (VALUES (0, 800), (1, 500), (2, 300)) v(ord, scale)), g AS (SELECT id, image_id, variant, engine, ord, scale FROM bench_records, s WHERE (id + scale) % 3 = 0)
SELECT id, image_id, variant, engine, CAST(arg_min(scale, ord) AS INT) AS scale FROM g GROUP BY ALL""",
    V,
)
def image_sweep_first_hit(spark, sf_dir):
    return R.first_scale_hit(_bench(spark, sf_dir), dims.SCALES)


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'fixed' ELSE classification END AS classification FROM bench_records", V)
def upsert_latest(spark, sf_dir):
    b = _bench(spark, sf_dir).select("id", "classification")
    return R.upserted(b, b.filter("id % 5 = 0").withColumn("classification", F.lit("fixed")))


_ENGINES = ", ".join(f"({i}, '{n}', '{s}')" for i, (n, *_, s) in enumerate(dims.SCANNERS))


@query("SELECT * FROM (VALUES (0, 'ZXing'), (1, 'html5-qrcode'), (2, 'Quagga2')) v(ord, name)")
def engine_plan(spark, sf_dir):
    return dims.scanners(spark).filter("status = 'available'").orderBy("ord").limit(3).select("ord", "name")


@query("""SELECT * FROM (VALUES ('ZXing', 'available'), ('ZXing-C++', 'available'), ('ZXing Android Embedded / ZXing Android', 'platform_unsupported'), ('zxing-cpp Python bindings / Pyzxing', 'platform_unsupported'),
  ('ZXing.Net (+ Windows/Maui bindings)', 'platform_unsupported')) v(name, status)""")
def engine_search(spark, sf_dir):
    return dims.scanners(spark).filter(F.lower("name").contains("zx")).select("name", "status")


@query(f"SELECT e.engine, coalesce(v.status, 'unknown') AS status, count(*) AS n FROM bench_records e LEFT JOIN (VALUES {_ENGINES}) v(ord, name, status) ON lower(v.name) = lower(e.engine) GROUP BY ALL", V)
def engine_status_join(spark, sf_dir):
    reg = F.broadcast(dims.scanners(spark).select(F.lower("name").alias("k"), "status"))
    b = _bench(spark, sf_dir).groupBy("engine").agg(F.count("*").alias("n"))
    return b.join(reg, F.lower("engine") == F.col("k"), "left").select("engine", F.coalesce("status", F.lit("unknown")).alias("status"), "n")


@query("SELECT * FROM (VALUES ('Available', 6), ('Unsupported/deprecated', 3), ('Failed', 1), ('Requires SDK/license configuration', 6), ('Not implemented', 4), ('Needs native/mobile environment', 11)) v(label, n)")
def engine_status_labels(spark, sf_dir):
    shown = R.labelled(F.col("status"), dims.STATUS_LABELS, F.col("status"))
    return dims.scanners(spark).groupBy(shown.alias("label")).agg(F.count("*").cast("int").alias("n"))


@query(
    """WITH l AS (SELECT *, last_value(CASE WHEN id % 11 <> 0 THEN [barcode_value] END IGNORE NULLS) OVER (PARTITION BY session_id, engine ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)[1] AS last FROM bench_records),
s AS (SELECT session_id, engine, arg_max(CASE WHEN id % 11 = 0 THEN 'FAILED' WHEN barcode_value IS NOT NULL THEN 'FOUND' ELSE 'MISS' END, id) AS shown, arg_max([CASE WHEN id % 11 = 0 THEN last ELSE barcode_value END], id)[1] AS last_value FROM l WHERE barcode_value IS NULL OR last IS NULL OR barcode_value <> last GROUP BY ALL)
SELECT * FROM s""",
    V,
)
def race_states(spark, sf_dir):
    frames = _bench(spark, sf_dir).select("session_id", "engine", F.col("id").alias("frame_number"), F.col("barcode_value").alias("value"), (F.col("id") % 11 == 0).alias("failed"))
    return R.race_states(frames).select("session_id", "engine", R.labelled(F.col("status"), dims.RACE_LABELS, F.lit("idle")).alias("shown"), "last_value")


@query(
    r"""SELECT id, CAST(id AS STRING) || ',' || session_id || ',' || CASE WHEN engine LIKE '%,%' THEN '"' || engine || '"' ELSE engine END || ',' || coalesce(barcode_value, '') || ',' || classification || ',' || coalesce(CAST(detection_time_ms AS STRING), '') || ',' || CASE WHEN success THEN 'true' ELSE 'false' END AS line FROM bench_records""",
    V,
)
def csv_export_row(spark, sf_dir):
    from veridex.sources.files import csv_line

    return _bench(spark, sf_dir).select("id", csv_line(["id", "session_id", "engine", "barcode_value", "classification", "detection_time_ms", "success"]).alias("line"))


@query("SELECT id, engine, barcode_value, detection_time_ms FROM bench_records", V)
def json_roundtrip(spark, sf_dir):
    b = _bench(spark, sf_dir)
    s = F.struct("id", "engine", "barcode_value", "detection_time_ms")
    back = F.from_json(F.to_json(s), "id bigint, engine string, barcode_value string, detection_time_ms bigint")
    return b.select(back.alias("r")).select("r.*")


@query("SELECT id, sha256(engine || '|' || session_id) AS fingerprint FROM bench_records", V)
def fingerprint_sha256(spark, sf_dir):
    return _bench(spark, sf_dir).select("id", F.sha2(F.concat("engine", F.lit("|"), "session_id"), 256).alias("fingerprint"))


@query(
    """WITH s AS (SELECT DISTINCT session_id FROM bench_records)
SELECT session_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(session_id) + 1), lambda i: ascii(substr(session_id, CAST(i AS BIGINT), 1))::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS hash FROM s""",
    V,
)
def fnv1a(spark, sf_dir):
    from veridex.functions.hashing import fnv1a_32

    return _bench(spark, sf_dir).select("session_id").distinct().select("session_id", fnv1a_32(F.col("session_id")).alias("hash"))


@query("SELECT date_trunc('hour', ts) AS window_start, user_id % 10 AS client, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY ALL")
def rate_limit_windows(spark, sf_dir):
    from veridex.operators.windows import rate_limited

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rate_limited(e, "ts", F.col("user_id") % 10, "1 hour", 2)


@query(
    """WITH r AS (SELECT event_id AS id, ts, user_id % 50 AS key, lag(ts) OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS prev FROM events)
SELECT id, prev IS NOT NULL AND epoch_us(ts) - epoch_us(prev) < 900000000 AS hit FROM r"""
)
def cache_replay_ttl(spark, sf_dir):
    from veridex.operators.windows import ttl_hits

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ttl_hits(e.select(F.col("event_id").alias("id"), "ts", (F.col("user_id") % 50).alias("key")), 900)


@query("SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE p IS NULL OR role <> p")
def dedupe_roles(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.withColumn("_p", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("_p is null or role <> _p").select("conv_id", "turn", "role")
