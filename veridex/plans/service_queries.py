"""Queries over what a service records: the keyed store, observed counters, samples, picks and places of codes; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veridex import dims
from veridex.functions import formats as fmt
from veridex.functions import net
from veridex.operators import fusion, metrics, records, samples
from veridex.plans.code_queries import _CONF, _GTIN, _SCORE, _TIER, _groups, _in, _obs, _valid
from veridex.plans.registry import query
from veridex.plans.stream_queries import _drained
from veridex.shipping import shared_dir
from veridex.sources import fetch
from veridex.sources.files import SIGNATURES, image_type
from veridex.sources.store import KeyedStore
from veridex.sources.views import view

B = ("bench_records",)


def _bench(spark, sf_dir):
    return view(spark, sf_dir, "bench_records")


# --- the store ---


def _filled(spark, sf_dir) -> KeyedStore:
    """All records; then those of every fifth id again with a later time and another class; every seventeenth removed."""
    rows = _bench(spark, sf_dir).select("id", "engine", "classification", F.lit(1).cast("bigint").alias("timestamp"))
    store = KeyedStore(spark, f"{shared_dir(spark)}/records-{uuid.uuid4().hex}", rows.schema, buckets=16)
    store.upsert(rows)
    store.add(rows.filter("id % 5 = 0").withColumns({"classification": F.lit("fixed"), "timestamp": F.lit(2).cast("bigint")}))
    store.delete(rows.filter("id % 17 = 3").select("id"))
    return store


_STORED = "SELECT id, engine, CASE WHEN id % 5 = 0 THEN 'fixed' ELSE classification END AS classification, CASE WHEN id % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS timestamp FROM bench_records WHERE id % 17 <> 3"


@query(_STORED, B)
def record_store(spark, sf_dir):
    """What a store holds after an import, an update and a removal."""
    return _filled(spark, sf_dir).read()


@query(f"{_STORED} AND id IN (3, 5, 20, 40, 41, 999999999)", B)
def record_lookup(spark, sf_dir):
    """Some records by their ids, one of them removed and one unknown."""
    return _filled(spark, sf_dir).lookup(3, 5, 20, 40, 41, 999999999)


@query("SELECT id, engine, classification FROM bench_records WHERE image_id = 7 AND variant = 'original' AND test_type = 'image'", B)
def outcomes_of_image(spark, sf_dir):
    """Outcomes of one image, of its original unless told."""
    return _bench(spark, sf_dir).filter("image_id = 7 and variant = 'original' and test_type = 'image'").select("id", "engine", "classification")


@query("SELECT session_id, min(ts) AS started, max(ts) AS ended, count(*) AS frames, " + ", ".join(f"count(*) FILTER (test_type = '{k}') AS {k}_frames" for k in ("live", "image", "angle")) + " FROM bench_records GROUP BY 1", B)
def session_counters(spark, sf_dir):
    return records.sessions(_bench(spark, sf_dir))


# --- observed counters ---

_COLUMNS = [
    "event_id % 11 = 0 AS failed", "CASE WHEN event_id % 4 <> 0 THEN event_type <> 'error' END AS barcode", "CASE WHEN event_id % 3 <> 0 THEN event_id % 5 < 3 END AS ocr", "event_id % 3 <> 0 AND event_id % 10 = 1 AS ingredients",
    "CASE WHEN event_id % 2 = 0 THEN event_id % 8 = 0 END AS cached", "CAST(floor(value) AS BIGINT) AS latency_ms", "event_type",
]
_ANALYSES = f"SELECT {', '.join(_COLUMNS)}"
_COUNTS = (
    f"WITH a AS ({_ANALYSES} FROM events), c AS (SELECT "
    + ", ".join(f"count(*) FILTER ({c})::BIGINT AS {k}" for k, c in metrics.COUNTERS.items())
    + ", coalesce(sum(latency_ms), 0)::BIGINT AS latency_total_ms, max(latency_ms)::BIGINT AS latency_max_ms FROM a)"
)
_RATES = ", ".join(f"CASE WHEN {' + '.join(of)} > 0 THEN CAST(format('{{:.4f}}', {n} / ({' + '.join(of)})::DOUBLE) AS DOUBLE) ELSE 0 END AS {k}" for k, (n, of) in metrics.RATES.items())


def _analyses(events):
    return events.selectExpr(*_COLUMNS)


@query(f"{_COUNTS} SELECT * FROM c")
def observed_counters(spark, sf_dir):
    """Counters that are observed while analyses are written; nothing is read for them."""
    rows, seen = metrics.observed(_analyses(spark.read.parquet(f"{sf_dir}/events.parquet")))
    rows.write.parquet(f"{shared_dir(spark)}/analyses-{uuid.uuid4().hex}")
    return metrics.counts_row(spark, seen.get)


@query(f"{_COUNTS} SELECT {_RATES} FROM c")
def observed_stream_rates(spark, sf_dir):
    """The five service rates from counters that a listener adds up over the batches of a stream."""
    name = f"service_{uuid.uuid4().hex}"
    path, totals = f"{sf_dir}/events.parquet", metrics.Totals(name)
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 8).parquet(path + "*")
    spark.streams.addListener(totals)
    try:
        rows = _drained(spark, _analyses(events).observe(name, *metrics.counters()))
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()  # the last batch's event may be under way
    finally:
        spark.streams.removeListener(totals)
    del rows
    return metrics.derived_rates(metrics.counts_row(spark, totals.counts))


# --- samples ---

_SAMPLE = f"s AS (SELECT engine, id, detection_time_ms FROM bench_records WHERE detection_time_ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY engine ORDER BY md5(id::VARCHAR), id) <= {samples.SAMPLE})"


@query(f"WITH {_SAMPLE} SELECT * FROM s", B)
def latency_sample(spark, sf_dir):
    """512 latencies of each engine, drawn by a hash of their ids: from two halves, and then of the whole."""
    some = _bench(spark, sf_dir).filter("detection_time_ms is not null").select("engine", "id", "detection_time_ms")
    halves = [samples.bottom_k(some.filter(f"pmod(id, 2) = {k}"), ["engine"], "id") for k in (0, 1)]
    return samples.merged(*halves, keys=["engine"], id="id")


@query(f"WITH {_SAMPLE}, v AS (SELECT engine, count(*) AS n, list_sort(list(detection_time_ms)) AS v FROM s GROUP BY engine) SELECT engine, n, v[least(n - 1, floor(n * 0.5)::BIGINT) + 1] AS p50, v[least(n - 1, floor(n * 95 / 100.0)::BIGINT) + 1] AS p95 FROM v", B)
def latency_sample_percentiles(spark, sf_dir):
    some = _bench(spark, sf_dir).filter("detection_time_ms is not null").select("engine", "id", "detection_time_ms")
    return samples.sampled_stats(samples.bottom_k(some, ["engine"], "id"), ["engine"], "detection_time_ms")


# --- codes: exclusion, places, scores of engines, picks ---

O = ("observations",)  # noqa: E741
_FLAT = f"['EAN-13', {_in(dims.TWO_D_FORMATS)}][1 + ord % 5]"


@query(f"SELECT s.side, count(*) AS observations, count(DISTINCT image_id) AS images FROM observations, (VALUES ('browser'), ('server')) s(side) WHERE {_FLAT} NOT IN ('QR Code', 'Data Matrix', 'Aztec') AND NOT (side = 'server' AND {_FLAT} = 'PDF417') GROUP BY 1", O)
def codes_without_2d(spark, sf_dir):
    """Observations left without two-dimensional codes; the browser's rule keeps PDF417, the server's does not."""
    shown = _obs(spark, sf_dir).withColumn("format", F.get(F.array(F.lit("EAN-13"), *[F.lit(x) for x in dims.TWO_D_FORMATS]), (F.col("ord") % 5).cast("int")))
    one = lambda side: fusion.without_2d(shown, side).select(F.lit(side).alias("side"), "image_id")
    return one("browser").unionAll(one("server")).groupBy("side").agg(F.count("*").alias("observations"), F.count_distinct("image_id").alias("images"))


_POINTS = "CASE WHEN ord % 3 = 0 THEN NULL WHEN ord % 3 = 1 THEN [] ELSE [{'x': (ord % 97) / 4.0::DOUBLE, 'y': (ord % 89) / 2.0::DOUBLE}, {'x': (ord % 61) / 4.0::DOUBLE, 'y': -((ord % 53) / 2.0::DOUBLE)}] END"


@query(
    f"""WITH o AS (SELECT image_id, trim(value) AS payload, ord, {_POINTS} AS points FROM observations), f AS (SELECT image_id, payload, arg_min(points, ord) AS p FROM o WHERE len(points) > 0 GROUP BY ALL)
SELECT a.image_id, a.payload, len(p) AS points, floor(least(p[1].x, p[2].x) + 0.5) AS x, floor(least(p[1].y, p[2].y) + 0.5) AS y, floor(abs(p[1].x - p[2].x) + 0.5) AS width, floor(abs(p[1].y - p[2].y) + 0.5) AS height
FROM (SELECT DISTINCT image_id, payload FROM o) a LEFT JOIN f USING (image_id, payload)""",
    O,
)
def candidate_places(spark, sf_dir):
    """Where a candidate stands: points and rounded box of its first observation that has any."""
    at = lambda m, d: ((F.col("ord") % m) / F.lit(d)).cast("double")
    two = F.array(F.struct(at(97, 4.0).alias("x"), at(89, 2.0).alias("y")), F.struct(at(61, 4.0).alias("x"), (-at(53, 2.0)).alias("y")))
    points = F.when(F.col("ord") % 3 == 1, F.slice(two, 1, 0)).when(F.col("ord") % 3 == 2, two)
    p = fusion.places(_obs(spark, sf_dir).withColumn("points", points))
    return p.select("image_id", "payload", F.when(F.col("points").isNotNull(), F.size("points").cast("bigint")).alias("points"), "box.x", "box.y", "box.width", "box.height")


_OWN = "CASE WHEN engine <> 'ZBar' AND ord % 4 = 0 THEN (decode_ms % 10) / 10.0::DOUBLE + 0.013::DOUBLE END"


@query(
    f"""WITH {_groups().replace("min(decode_ms) AS fastest_ms", f"min(decode_ms) AS fastest_ms, max({_OWN}) AS own")}, s AS (SELECT *, CASE WHEN {_GTIN} THEN 'gtin' ELSE 'other' END || CASE WHEN {_valid()} THEN '_valid' ELSE '_invalid' END AS structural FROM h)
SELECT image_id, payload, CAST(round(CAST(format('{{:.3f}}', {_SCORE.replace("0e0 * 0.03e0", "coalesce(own, 0e0) * 0.03e0")}) AS DOUBLE) * 1000) AS INT) AS confidence, CASE WHEN own IS NULL THEN 'derived' ELSE 'engine' END AS confidence_source FROM s""",
    O,
)
def fusion_engine_confidence(spark, sf_dir):
    """Confidence where some engines score for themselves: their best score counts, and is told as the source."""
    own = F.when((F.col("engine") != "ZBar") & (F.col("ord") % 4 == 0), (F.col("decode_ms") % 10) / F.lit(10.0) + F.lit(0.013))
    g = fusion.with_confidence(fusion.groups(_obs(spark, sf_dir).withColumn("engine_confidence", own)))
    return g.select("image_id", "payload", "confidence", "confidence_source")


@query(f"WITH {_CONF}, pk AS (SELECT image_id, arg_min(value, ({_TIER}, position)) AS picked, arg_min(value, position) AS served FROM t WHERE position <= 5 GROUP BY image_id) SELECT image_id, picked, served, picked = served AS agrees FROM pk", O)
def pick_agreement(spark, sf_dir):
    """Whether a client that picks by its own rule gets the candidate that the service ranks first."""
    return fusion.pick_agreement(fusion.kept(fusion.ranked(_obs(spark, sf_dir))))


# --- addresses ---


@query(
    "WITH h AS (SELECT c_custkey, ['example.com', '10.0.0.' || (c_custkey % 300), '::ffff:1.2.3.4', 'fe80::' || (c_custkey % 10), '1.2.3', '01.2.3.4', '[::1]', ''][1 + c_custkey % 8] AS host FROM customer) SELECT c_custkey, host, CASE c_custkey % 8 WHEN 1 THEN c_custkey % 300 < 256 WHEN 2 THEN true WHEN 3 THEN true WHEN 6 THEN true ELSE false END AS literal FROM h"
)
def ip_literals(spark, sf_dir):
    """Which hosts are bare addresses."""
    k = F.col("c_custkey")
    hosts = F.array(F.lit("example.com"), F.concat(F.lit("10.0.0."), (k % 300).cast("string")), F.lit("::ffff:1.2.3.4"), F.concat(F.lit("fe80::"), (k % 10).cast("string")), F.lit("1.2.3"), F.lit("01.2.3.4"), F.lit("[::1]"), F.lit(""))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.get(hosts, (k % 8).cast("int")).alias("host"))
    return c.withColumn("literal", net.is_ip_literal(F.col("host")))


# --- payloads ---

@query(
    """WITH u AS (SELECT page_id, strlen(coalesce(html, '')) AS n, coalesce(html, '') AS html, CASE WHEN url IS NULL OR trim(url) = '' THEN 'VALIDATION_ERROR' WHEN length(trim(url)) > 2048 OR NOT regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'INVALID_URL'
  WHEN NOT regexp_matches(trim(url), '^https?:', 'i') THEN 'UNSUPPORTED_SCHEME' WHEN regexp_extract(trim(url), '^[A-Za-z]+://([^/?#]*)', 1) = '' THEN 'INVALID_URL' END AS bad FROM pages),
e AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN page_id % 7 < 2 THEN 'BLOCKED_URL' WHEN page_id % 7 = 2 THEN 'DOWNLOAD_FAILED' WHEN n > 3000 THEN 'DOWNLOAD_TOO_LARGE' END AS error FROM u)
SELECT page_id, CASE WHEN error IS NULL THEN n::BIGINT END AS bytes, CASE WHEN error IS NULL THEN sha256(html) END AS digest, error FROM e"""
)
def fetched_pages(spark, sf_dir):
    """Payloads of pages, written as files and read back through their list: addresses and redirects judged, 3,000 bytes at most."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = lambda *u: F.array(*[F.lit(x) for x in u])
    k = F.col("page_id") % 7
    hops = F.when(k == 0, urls("http://169.254.169.254/latest")).when(k == 1, urls("https://example.org/a", "http://[::1]/")).when(k == 2, urls(*[f"https://a.example/{i}" for i in (1, 2, 3, 4)]))
    places = fetch.payload_files(pages.select("page_id", "html"), "page_id", "html")
    listed = places.join(pages.select(F.col("page_id").alias("key"), "url", hops.alias("hops")), "key")
    got = fetch.fetched(listed, most_bytes=3000, allow_http=True)
    return got.select(F.col("key").cast("bigint").alias("page_id"), "bytes", F.sha2("content", 256).alias("digest"), "error")


#: What begins a file of each kind, with any byte where the kind leaves it open.
_BEGIN = [pattern.rstrip("%").replace("_", "0") for pattern, _ in SIGNATURES]


@query("SELECT page_id, ['jpeg', 'png', 'webp', 'gif', 'bmp', 'avif', 'avif', 'heif', 'heif', 'heif', 'tiff', 'tiff', NULL][page_id % 13 + 1] AS kind FROM pages")
def image_kinds(spark, sf_dir):
    """The kinds that the first bytes of payloads tell; each thirteenth begins like no image."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    begin = F.get(F.array(*[F.lit(b) for b in _BEGIN], F.lit("00")), (F.col("page_id") % 13).cast("int"))
    payload = F.concat(F.unhex(begin), F.coalesce("html", F.lit("")).cast("binary"))
    return p.select("page_id", payload.alias("content")).select("page_id", image_type("content").alias("kind"))
