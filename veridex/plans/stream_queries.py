"""Stateful stream operators applied to the events table; streams run to their end and their table is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veridex.plans.registry import query
from veridex.shipping import shared_dir, ship
from veridex.streaming import race


def _frames(spark, sf_dir, stream: bool):
    path = f"{sf_dir}/events.parquet"
    e = spark.read.parquet(path)
    if stream:
        folder, name = path.rsplit("/", 1)
        e = spark.readStream.schema(e.schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 8).parquet(f"{folder}/{name}*")
    value = F.when(F.col("event_id") % 5 < 4, F.concat(F.lit("890"), ((F.col("event_id") % 7) * (F.col("user_id") % 3)).cast("string")))
    return e.select(F.concat(F.lit("session-"), (F.col("user_id") % 20).cast("string")).alias("session_id"), F.col("event_type").alias("engine"), F.col("event_id").alias("frame_number"), F.col("ts").cast("timestamp").alias("ts"), value.alias("value"), (F.col("event_id") % 11 == 0).alias("failed"), F.floor("value").cast("double").alias("latency_ms"))


def _drained(spark, df, mode: str = "append"):
    """The stream's whole table, written below the checkpoint folder by the executors; a replayed batch changes nothing."""
    ship(spark)
    name = f"t{uuid.uuid4().hex}"
    shared = shared_dir(spark)
    table = f"{shared}/{name}-table"
    spark.createDataFrame([], df.schema).write.parquet(f"{table}/batch=-1")

    def write(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={0 if mode == 'complete' else number}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{shared}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{table}/batch=*")


@query(
    """WITH f AS (SELECT 'session-' || (user_id % 20) AS session_id, event_type AS engine, event_id AS frame_number, CASE WHEN event_id % 5 < 4 THEN '890' || ((event_id % 7) * (user_id % 3)) END AS value, event_id % 11 = 0 AS failed, CAST(floor(value) AS BIGINT) AS ms FROM events),
l AS (SELECT *, last_value(CASE WHEN NOT failed THEN [value] END IGNORE NULLS) OVER (PARTITION BY session_id, engine ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)[1] AS last FROM f),
k AS (SELECT *, CASE WHEN value = last THEN 'duplicate' WHEN NOT failed AND value IS NOT NULL THEN 'correct' ELSE 'miss' END AS classification FROM l),
r AS (SELECT *, count(*) FILTER (classification <> 'duplicate') OVER w AS total_frames, count(*) FILTER (classification = 'correct') OVER w AS detections, list(ms) FILTER (value IS NOT NULL AND ms IS NOT NULL) OVER w AS lat FROM k WINDOW w AS (PARTITION BY session_id, engine ORDER BY frame_number))
SELECT session_id, engine, frame_number, classification, classification <> 'duplicate' AS kept, total_frames, detections, CASE WHEN failed THEN last ELSE value END AS last_value, list_sort(lat[-2000:])[least(len(lat[-2000:]) - 1, len(lat[-2000:]) // 2) + 1] AS median_ms FROM r"""
)
def stream_race_state(spark, sf_dir):
    return _drained(spark, race.race(_frames(spark, sf_dir, True)))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type AS engine, count(floor(value)) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_ms, CAST(max(floor(value)) AS BIGINT) AS max_ms FROM events GROUP BY ALL")
def stream_latency_windows(spark, sf_dir):
    out = _drained(spark, race.latency_windows(_frames(spark, sf_dir, True), "1 hour"), "complete")
    return out.select(F.col("w.start").alias("window_start"), "engine", "n", F.col("total_ms").cast("bigint").alias("total_ms"), F.col("max_ms").cast("bigint").alias("max_ms"))
