"""Stateful streams over frames: duplicate suppression with running statistics, rate limits and the record sink.

A frame is (session_id, engine, frame_number, ts, value, failed, latency_ms). State is kept per session and
engine, and dropped when no frame came for IDLE; event time bounds it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

LATENCIES = 2000
IDLE_MS = 3_600_000
OUT = "session_id string, engine string, frame_number long, classification string, kept boolean, total_frames long, detections long, last_value string, median_ms long"
#: Rows of a frame of output.
OUT_ROWS = 10_000


def step(state: tuple, frame: tuple, expected: str | None = None) -> tuple[tuple, str, bool]:
    """(state, classification, kept) after a frame (value, failed, latency).

    A repeat of the last value is a duplicate: its latency counts, the frame does not. A miss forgets the last
    value, a failed frame keeps it.
    """
    total, hits, last, lat = state
    value, failed, ms = frame
    found = value is not None and not failed
    more = [*lat, int(ms + 0.5)][-LATENCIES:] if value is not None and ms is not None and not pd.isna(ms) else lat
    if value is not None and last is not None and value == last:
        return (total, hits, last, more), "duplicate", False
    if failed:
        return (total + 1, hits, last, more), "miss", True
    if found:
        return (total + 1, hits + 1, value, more), "correct" if not expected or value == expected else "incorrect", True
    return (total + 1, hits, None, lat), "miss", True


class Race(StatefulProcessor):
    """Keeps a value (counts and last value) and a ring of the last LATENCIES latencies of a session's engine.

    State is written once for each key and batch. Of a batch's frames of one key only the four fields that count are
    held, to put them in order: as much as a trigger takes in (see `race`). A timer of event time drops the state
    when no frame came for IDLE_MS.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "total_frames long, detections long, last_value string")
        self.ring = handle.getListState("latencies", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        latest, frames = 0, []
        for part in rows:
            latest = max(latest, int(pd.to_datetime(part["ts"]).max().timestamp() * 1000))
            frames += part[["frame_number", "value", "failed", "latency_ms"]].itertuples(index=False, name=None)
        frames.sort(key=lambda f: f[0])
        due = list(self.handle.listTimers())
        if any(t <= timerValues.getCurrentWatermarkInMs() for t in due):  # frames come before timers of the same batch
            self.now.clear()
            self.ring.clear()
        before = [x[0] for x in self.ring.get()]
        state = (*(self.now.get() if self.now.exists() else (0, 0, None)), before)
        out, ranked = [], sorted(before)
        for n, value, failed, ms in frames:
            had = state[3]
            state, kind, kept = step(state, (value if isinstance(value, str) else None, bool(failed), ms))
            if state[3] is not had:
                insort(ranked, state[3][-1])
                if len(ranked) > len(state[3]):
                    ranked.pop(bisect_left(ranked, had[0]))
            out.append((*key, int(n), kind, kept, *state[:3], ranked[min(len(ranked) - 1, len(ranked) // 2)] if ranked else None))
        self.now.update(state[:3])
        if state[3] is not before:
            self.ring.put([(int(x),) for x in state[3]])
        for t in due:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + IDLE_MS)
        names = [c.split()[0] for c in OUT.split(", ")]
        for k in range(0, len(out), OUT_ROWS):
            yield pd.DataFrame(out[k : k + OUT_ROWS], columns=names).astype({"median_ms": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.now.clear()
        self.ring.clear()
        return iter(())

    def close(self) -> None:
        pass


def race(frames: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream of frames to classified frames with the running state of their session's engine.

    State lives in RocksDB, which the session is set to unless it has another store already. Let the source take in
    a bounded number of files or bytes at each trigger (maxFilesPerTrigger, maxBytesPerTrigger).
    """
    conf, store = frames.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in conf.get(store, "HDFSBacked"):
        conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return frames.withWatermark("ts", late).groupBy("session_id", "engine").transformWithStateInPandas(Race(), OUT, "Append", "EventTime")


def limited(events: DataFrame, ts: str, client: Column, width: str, most: int, late: str = "10 minutes") -> DataFrame:
    """Stream of windows in which a client made more than `most` requests; a window closes when the watermark passes it."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), client.alias("client")).agg(F.count("*").alias("n"))
    return g.filter(F.col("n") > most).select(F.col("w.start").alias("window_start"), "client", "n")


def record_sink(path: str, key: str = "id", order: str = "timestamp"):
    """A foreachBatch function that stores micro-batches for stored_records; a replayed batch changes nothing.

    Of a batch's rows with one key that of the greatest order stays. Batches are only added, so nothing stored is
    read again.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest_by(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the greatest order of each key; of equal ones the greatest in its values."""
    rank = F.struct(F.col(f"`{order}`"), *[F.col(f"`{c}`") for c in rows.columns if c not in (key, order)])
    return rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), rank).alias("_row")).select("_row.*")


def stored_records(spark, path: str, key: str = "id") -> DataFrame:
    """What record_sink stored: the row of the latest batch of each key."""
    return latest_by(spark.read.parquet(path), key, "batch").drop("batch")


def latency_windows(frames: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Stream of latency statistics per engine in event-time windows."""
    return frames.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "engine").agg(F.count("latency_ms").alias("n"), F.sum("latency_ms").alias("total_ms"), F.max("latency_ms").alias("max_ms"))


def backoff_ms(attempt: Column, unit_draw: Column, base: int = 400, cap: int = 4000) -> Column:
    """Full-jitter exponential backoff of an attempt (from 0), given a uniform draw."""
    return F.floor(unit_draw * F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt)))
