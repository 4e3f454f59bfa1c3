"""Streams against folds, cache replay, files and raster kernels against plain loops."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridex.operators import windows
from veridex.plans import stream_queries
from veridex.raster import frames, kernels
from veridex.sources import files
from veridex.streaming import race

from .conftest import DATA


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stream_equals_fold(spark):
    got = {(r.session_id, r.engine, r.frame_number): r for r in stream_queries.stream_race_state(spark, DATA).collect()}
    state = {}
    rows = stream_queries._frames(spark, DATA, False).orderBy("frame_number").collect()
    assert len(rows) == len(got)
    for f in rows:
        k = (f.session_id, f.engine)
        state[k], kind, kept = race.step(state.get(k, (0, 0, None, [])), (f.value, f.failed, f.latency_ms))
        g = got[(*k, f.frame_number)]
        assert (g.classification, g.kept, g.total_frames, g.last_value) == (kind, kept, state[k][0], state[k][2])


def test_race_over_many_batches(spark, tmp_path, monkeypatch):
    """A file a batch: the ring keeps its last latencies only, a long pause drops the state, frames of a batch may come in any order."""
    frames = [("s", "e", k, 5_000 + 1_000 * k, ["a", "a", "b", None][k % 4], k % 7 == 6, float(k % 50)) for k in range(3000)]
    frames += [("s", "e", 3000 + k, 40_000_000 + k, "z", False, 5.0) for k in range(20)] + [("t", "e", 1, 40_000_500, None, False, None)]
    frames += [("u", "e", 1, 60_000_000, "x", False, 1.0), ("t", "e", 2, 60_000_050, "y", False, 1.0), ("s", "e", 4000, 60_000_100, "z", False, 2.0)]
    schema = "session_id string, engine string, frame_number long, at long, value string, failed boolean, latency_ms double"
    cuts = [0, 900, 1800, 3000, 3021, 3022, 3024]  # the batch of u moves the watermark past the others' timers
    src = str(tmp_path / "in")
    for a, b in zip(cuts[:-1], cuts[1:]):
        spark.createDataFrame(frames[a:b][::-1], schema).selectExpr("session_id", "engine", "frame_number", "timestamp_millis(at) AS ts", "value", "failed", "latency_ms").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken in by their time
    stream = spark.readStream.schema("session_id string, engine string, frame_number long, ts timestamp, value string, failed boolean, latency_ms double").option("maxFilesPerTrigger", 1).parquet(src)
    got = {(r.session_id, r.frame_number): r for r in stream_queries._drained(spark, race.race(stream, "1 second")).collect()}
    assert len(got) == len(frames) and "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state = {}
    for s, _, n, at, value, failed, ms in frames:
        if n == 4000 or (s, n) == ("t", 2):
            state.pop(s, None)  # idle for more than an hour of event time
        state[s], kind, kept = race.step(state.get(s, (0, 0, None, [])), (value, failed, ms))
        g, ranked = got[s, n], sorted(state[s][3])
        assert (g.classification, g.kept, g.total_frames, g.detections, g.last_value, g.median_ms) == (kind, kept, *state[s][:3], ranked[min(len(ranked) - 1, len(ranked) // 2)] if ranked else None), n
    assert len(state["s"][3]) == 1


def test_step():
    s = (0, 0, None, [])
    s, kind, kept = race.step(s, ("a", False, 10.4))
    assert (kind, kept, s) == ("correct", True, (1, 1, "a", [10]))
    s, kind, kept = race.step(s, ("a", False, 20))
    assert (kind, kept, s) == ("duplicate", False, (1, 1, "a", [10, 20]))
    s, kind, _ = race.step(s, (None, True, None))
    assert kind == "miss" and s[2] == "a"  # a failed frame keeps the last value
    s, _, _ = race.step(s, (None, False, None))
    assert s[2] is None


def test_cache(spark):
    trace = [("get", "k1"), ("set", "k1"), ("set", "k2"), ("get", "k1"), ("set", "k3"), ("get", "k2")]
    df = spark.createDataFrame([("c", i, o, k, i) for i, (o, k) in enumerate(trace)], "cache string, seq int, op string, key string, at_ms bigint")
    assert tuple(windows.lru_replay(df, 2, 1000).first())[1:] == (1, 2, 1, 2)
    assert windows.lru_replay(df, 0, 1000).first().hits == 0
    assert windows.lru_replay(df, 2, 1).first().hits == 0


def test_files(spark, tmp_path):
    p = str(tmp_path / "r.json")
    open(p, "w").write('[{"engine":"a","timestamp":1,"barcode_value":"x,\\"y"},{"engine":"b"},{"timestamp":3}]')
    r = files.read_records(spark, p)
    assert r.count() == 1 and r.first().id
    assert r.select(files.csv_line(["engine", "barcode_value", "angle"])).first()[0] == 'a,"x,""y",'
    for write, out in ((files.write_csv, "c"), (files.write_json, "j")):
        write(r, str(tmp_path / out))
    files.write_json(r, str(tmp_path / "p"), pretty=True)
    files.write_text(r, "engine", str(tmp_path / "t"))
    files.write_records(r.withColumn("test_type", F.lit("live")), str(tmp_path / "s"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().barcode_value == 'x,"y'
    assert spark.read.parquet(str(tmp_path / "s")).filter("test_type = 'live'").count() == 1
    img = kernels.from_plane(np.arange(64).reshape(8, 8))
    open(tmp_path / "a.png", "wb").write(kernels.to_png(img))
    open(tmp_path / "b.txt", "w").write("not an image")
    got = files.read_images(spark, str(tmp_path / "*.[pt]*"))
    assert [r.image_type for r in got.collect()] == ["png"]


def test_sink(spark, tmp_path):
    """Later batches put their rows in place of earlier ones; a replayed batch changes nothing."""
    write = race.record_sink(str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame(list(r), "id string, v string, timestamp bigint")
    batches = [rows(("1", "old", 5), ("2", "a", 1), ("1", "older", 4)), rows(("1", "new", 3), ("3", "c", 1), ("3", "d", 1)), rows(("4", None, None))]
    for k in (0, 1, 1, 2):
        write(batches[k], k)
    got = {r.id: r.v for r in race.stored_records(spark, str(tmp_path / "s")).collect()}
    assert got == {"1": "new", "2": "a", "3": "d", "4": None}


def test_kernels():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (40, 36, 4), dtype=np.uint8)
    g = kernels.luminance(img)
    out = kernels.adaptive_threshold(img)[..., 0]
    for y, x in ((0, 0), (39, 35), (20, 18), (3, 30)):
        part = g[max(0, y - 15) : y + 16, max(0, x - 15) : x + 16]
        assert out[y, x] == (255 if g[y, x] > part.mean() - 10 else 0)
    levels = [(g <= t).sum() * (g > t).sum() * (g[g <= t].mean() - g[g > t].mean()) ** 2 if (g <= t).any() and (g > t).any() else 0 for t in range(256)]
    assert abs(int(np.argmax(levels)) - kernels.otsu_level(g)) <= 2
    d = kernels.denoise(img)[..., 0]
    assert d[5, 5] == sorted(kernels.grayscale(img)[4:7, 4:7, 0].ravel())[4]
    for name in frames.kernels._ONE:
        v = kernels.variant(img, name)
        assert v.ndim == 3 and v.shape[2] == 4 and v.dtype == np.uint8
    assert kernels.variant(img, "rotate_90").shape[:2] == (36, 40) and kernels.upscale(img, 3).shape[:2] == (120, 108)
    assert kernels.quality(np.zeros((9, 9, 4), np.uint8))[0] == "poor"
    assert kernels.text_regions(img) == []


def test_decoders(spark):
    img = kernels.from_plane(np.zeros((4, 4)))
    df = spark.createDataFrame([(1, 4, 4, bytearray(img.tobytes()))], "image_id bigint, width int, height int, data binary")

    def broken(_):
        raise ValueError("no")

    got = {r.engine: r for r in frames.observations(df, {"ok": lambda i: [("v", "EAN-13")], "broken": broken}).collect()}
    assert got["ok"].value == "v" and got["broken"].error == "no"


def test_streams_are_drained_to_files(spark):
    """The table of a stream is read from files, not from rows collected to the driver."""
    import os

    import pytest

    from veridex.plans import stream_queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    events = spark.read.parquet(f"{data}/events.parquet")
    out = stream_queries.stream_race_state(spark, data)
    assert out.inputFiles() and out.count() == events.count()
    hours = stream_queries.stream_latency_windows(spark, data)
    assert hours.inputFiles() and hours.groupBy().sum("n").first()[0] == events.filter("value is not null").count()


def test_manifest(spark, tmp_path):
    import json

    fixtures = [{"file": "a.png", "kind": "generated", "expect": {"barcode": "1", "mrp": {"amount": 5, "currency": "INR"}}}, {"file": "b.png", "kind": "upstream-photo", "note": "n"}]
    (tmp_path / "m.json").write_text(json.dumps({"generated_by": "x", "fixtures": fixtures}, indent=1))
    m = files.read_manifest(spark, f"file://{tmp_path}/m.json")
    got = {r.file: r for r in files.with_expectations(spark.createDataFrame([("a.png", "1"), ("b.png", "2"), ("c.png", None)], "file string, value string"), m).collect()}
    assert got["a.png"].expect.barcode == "1" and got["a.png"].expect.mrp.amount == 5 and got["b.png"].expect is None and got["c.png"].expect is None
