"""The keyed store, observed counters and bounded samples on rows with known results."""

import random

from pyspark.sql import functions as F

from veridex.functions import net
from veridex.operators import fusion, metrics, samples
from veridex.sources import fetch
from veridex.sources.store import KeyedStore

SCHEMA = "id string, timestamp bigint, v string"


def held(store):
    return {r.id: (r.timestamp, r.v) for r in store.read().collect()}


def files(store):
    return {r.f: r.bucket for r in store._files().select("bucket", F.col("_metadata.file_path").alias("f")).distinct().collect()}


def test_an_update_touches_its_buckets_only(spark, tmp_path):
    s = KeyedStore(spark, f"file://{tmp_path}/s", SCHEMA, buckets=8)
    assert held(s) == {} and s.upsert(spark.createDataFrame([], SCHEMA)) == []
    s.upsert(spark.createDataFrame([(f"k{i}", 1, "a") for i in range(200)], SCHEMA))
    before = files(s)
    touched = s.upsert(spark.createDataFrame([("k3", 2, "b"), ("k3", 3, "c"), ("new", 1, "d"), ("k4", 0, "older")], SCHEMA))
    after = files(s)
    assert 0 < len(touched) <= 3 and {f for f, b in before.items() if b not in touched} <= set(after)
    assert not {f for f, b in before.items() if b in touched} & set(after)
    want = {f"k{i}": (1, "a") for i in range(200)} | {"k3": (3, "c"), "new": (1, "d")}
    assert held(s) == want
    plan = s._files(touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.id for r in s.lookup("k3", "k7", "nobody").collect()} == {"k3", "k7"}
    again = KeyedStore(spark, f"file://{tmp_path}/s", SCHEMA, buckets=8)  # opened once more, nothing is lost
    assert held(again) == want


def test_added_files_are_compacted(spark, tmp_path):
    s = KeyedStore(spark, f"file://{tmp_path}/s", SCHEMA, buckets=4)
    rnd, want = random.Random(2), {}
    for t in range(6):
        rows = [(f"k{rnd.randrange(40)}", t, f"{t}-{j}") for j in range(25)]
        for i, at, v in rows:
            want[i] = max(want.get(i, (-1, "")), (at, v))
        s.add(spark.createDataFrame(rows, SCHEMA))
        s.add(spark.createDataFrame(rows, SCHEMA))  # replayed
    assert held(s) == want and len(files(s)) == 48
    assert s.compact(20) == [] and s.compact(3) == [0, 1, 2, 3] and len(files(s)) == 4 and held(s) == want
    s.delete(spark.createDataFrame([("k1",), ("k2",), ("nobody",)], "id string"))
    for k in ("k1", "k2"):
        want.pop(k, None)
    assert held(s) == want
    s.delete(spark.createDataFrame([(k,) for k in want], "id string"))
    assert held(s) == {}
    write = s.sink()
    for number in (0, 1, 1):
        write(spark.createDataFrame([("a", number, "x"), ("b", 5, "y")], SCHEMA), number)
    assert held(s) == {"a": (1, "x"), "b": (5, "y")}


def test_observed(spark):
    rows = [(True, True, None, False, None, 5), (False, False, True, True, True, 7), (False, None, False, False, False, None)]
    df = spark.createDataFrame(rows, "failed boolean, barcode boolean, ocr boolean, ingredients boolean, cached boolean, latency_ms bigint")
    out, seen = metrics.observed(df, "three")
    assert out.count() == 3
    got = metrics.derived_rates(metrics.counts_row(spark, seen.get)).first().asDict()
    assert got == {"barcode_detection_rate": 0.5, "ocr_success_rate": 0.5, "ingredient_extraction_rate": 0.5, "cache_hit_rate": 0.5, "error_rate": 0.3333}
    assert seen.get["latency_total_ms"] == 12 and seen.get["latency_max_ms"] == 7
    assert set(metrics.derived_rates(metrics.counts_row(spark, {})).first()) == {0.0}


def test_samples_merge(spark, tmp_path):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 1000).alias("v"))
    whole = {tuple(r) for r in samples.bottom_k(df, ["g"], "id", 20).collect()}
    thirds = [samples.bottom_k(df.filter(f"id % 7 {c}"), ["g"], "id", 20) for c in ("= 0", "in (1, 2)", "> 2")]
    assert {tuple(r) for r in samples.merged(*thirds, keys=["g"], id="id", k=20).collect()} == whole and len(whole) == 60
    write = samples.sample_sink(f"file://{tmp_path}/s", ["g"], "id", 20)
    for n, c in ((0, "id < 100"), (1, "id >= 100 and id < 4000"), (1, "id >= 100 and id < 4000"), (2, "id >= 4000")):
        write(df.filter(c), n)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/s/batch=2").collect()} == whole
    assert samples.bottom_k(df.limit(0), ["g"], "id").count() == 0
    share = spark.createDataFrame([(r[0],) for r in whole], "id bigint").filter("id < 2500").count() / 60
    assert 0.25 < share < 0.75  # a hash of the id does not favour its size


def test_places_and_picks(spark):
    p = lambda *xy: [{"x": x, "y": y} for x, y in xy]
    obs = [("i", 1, "A", "EAN-13", None), ("i", 2, "A ", "EAN-13", []), ("i", 3, "A", "UPC-A", p((1.4, 2.5), (3.6, -1.0))), ("i", 4, "A", "EAN-13", p((9.0, 9.0))), ("i", 5, "B", "QR Code", None), ("i", 6, " ", "EAN-13", p((0.0, 0.0)))]
    df = spark.createDataFrame(obs, "image_id string, ord bigint, value string, format string, points array<struct<x double, y double>>")
    got = {r.payload: r for r in fusion.places(df).collect()}
    assert set(got) == {"A", "B"} and tuple(got["A"].box) == (1.0, -1.0, 2.0, 4.0) and len(got["A"].points) == 2 and got["B"].box is None
    assert {side: fusion.without_2d(spark.createDataFrame([("PDF417",), ("Aztec",), ("EAN-8",)], "format string"), side).count() for side in ("server", "browser")} == {"server": 1, "browser": 2}
    hosts = spark.createDataFrame([("1.2.3.4",), ("1.2.3",), ("::1",), ("a:b",), (None,)], "h string").select(net.is_ip_literal(F.col("h"))).collect()
    assert [r[0] for r in hosts] == [True, False, True, False, False]


def test_fetched(spark, tmp_path):
    png, gif = bytes.fromhex("89504E470D0A1A0A") + b"x" * 20, b"GIF89a" + b"y" * 10
    rows = [(1, png), (2, gif), (3, b"plain"), (4, b"z" * 200), (5, None), (6, png)]
    places = fetch.payload_files(spark.createDataFrame(rows, "id int, b binary").repartition(2), "id", "b")
    assert places.count() == 6 and places.select("location").distinct().count() <= 2
    urls = {1: ("https://a.example/1", None), 2: ("https://a.example/2", ["https://b.example/"]), 3: ("https://a.example/3", []), 4: ("https://a.example/4", None), 5: ("ftp://a.example/5", None), 6: ("https://a.example/6", ["https://10.0.0.8/"])}
    more = [("7", "https://a.example/7", ["https://x.example/"] * 4, "file:///nowhere", 0, 5), ("8", "https://a.example/8", None, f"file://{tmp_path}/gone", 0, 5), ("9", "https://a.example/9", None, None, 0, 100_000)]
    lookup = spark.createDataFrame([(k, u, h) for k, (u, h) in urls.items()], "key int, url string, hops array<string>")
    listed = places.join(lookup, "key").selectExpr("string(key) AS key", "url", "hops", "location", "offset", "length").unionByName(spark.createDataFrame(more, "key string, url string, hops array<string>, location string, offset bigint, length bigint"))
    got = {r.key: r for r in fetch.fetched(listed, most_bytes=100).collect()}
    assert len(got) == 9 and bytes(got["1"].content) == png and bytes(got["2"].content) == gif and bytes(got["3"].content) == b"plain"
    assert (got["1"].image_type, got["2"].image_type, got["3"].image_type) == ("png", "gif", None)
    errors = {k: r.error for k, r in got.items() if r.error}
    assert errors.pop("8").startswith("DOWNLOAD_FAILED") and errors == {"4": "DOWNLOAD_TOO_LARGE", "5": "UNSUPPORTED_SCHEME", "6": "BLOCKED_URL", "7": "DOWNLOAD_FAILED", "9": "DOWNLOAD_TOO_LARGE"}
    only = {r.key: (r.error, r.content is None) for r in fetch.fetched(listed, most_bytes=100, kinds=["png"]).collect()}
    assert only["1"] == (None, False) and only["2"] == only["3"] == ("UNSUPPORTED_MEDIA_TYPE", True) and only["6"][0] == "BLOCKED_URL"
    assert fetch.fetched(listed.limit(0)).count() == 0
