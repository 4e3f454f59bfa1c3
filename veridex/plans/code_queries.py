"""Queries over observations of codes and over URLs and addresses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridex import dims
from veridex.functions import formats as fmt
from veridex.functions import net
from veridex.operators import fusion
from veridex.plans.registry import query
from veridex.sources.views import view

V = ("observations",)


def _in(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _check(v: str) -> str:
    return f"(regexp_matches({v}, '^([0-9]{{8}}|[0-9]{{12,14}})$') AND list_sum(list_transform(range(1, length({v}) + 1), lambda i: coalesce(try_cast(substr(reverse({v}), CAST(i AS BIGINT), 1) AS INT), 0) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 = 0)"


def _valid(v: str = "value", f: str = "format") -> str:
    return f"""CASE WHEN {f} = 'EAN-13' THEN regexp_matches({v}, '^[0-9]{{13}}$') AND {_check(v)} WHEN {f} = 'EAN-8' THEN regexp_matches({v}, '^[0-9]{{8}}$') AND {_check(v)}
  WHEN {f} = 'UPC-A' THEN regexp_matches({v}, '^[0-9]{{12}}$') AND {_check(v)} WHEN {f} = 'UPC-E' THEN regexp_matches({v}, '^0[0-9]{{6}}$') WHEN {f} IN ({_in(dims.NUMERIC_FORMATS)}) THEN length({v}) >= 4 AND regexp_matches({v}, '^[ -~]+$') ELSE length({v}) > 0 END"""


_GTIN = f"format IN ({_in(dims.RETAIL_FORMATS)})"


def _groups(obs: str = "observations") -> str:
    return f"""o AS (SELECT *, trim(value) AS payload, {_GTIN} AS gtin, {_valid()} AS ok FROM {obs}),
p AS (SELECT image_id, payload, format, sum(CASE WHEN gtin THEN CASE WHEN ok THEN 3.0 ELSE 1.0 END ELSE CASE WHEN ok THEN 2.0 ELSE 0.5 END END) + CASE format WHEN 'EAN-13' THEN 0.1 WHEN 'EAN-8' THEN 0.05 ELSE 0 END AS w, min(ord) AS first FROM o GROUP BY image_id, payload, format),
f AS (SELECT image_id, payload, arg_max(format, (w, -first)) AS format, string_agg(format, ',' ORDER BY first) AS formats FROM p GROUP BY ALL),
g AS (SELECT o.image_id, o.payload, arg_min(o.value, ord) AS value, min(ord) AS first_ord, count(DISTINCT engine) AS agreement, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines, string_agg(DISTINCT variant, ',' ORDER BY variant) AS variants, count(*) AS observations, min(decode_ms) AS fastest_ms FROM o GROUP BY ALL),
h AS (SELECT g.*, f.format, f.formats FROM g JOIN f USING (image_id, payload))"""


#: The weights of the score, written out: agreement, consistency of repeated sightings, structure, and what a format is worth.
_SCORE = """CASE agreement WHEN 1 THEN 0.45e0 WHEN 2 THEN 0.8e0 ELSE 1e0 END * 0.35e0 + CASE WHEN observations <= 1 THEN 0e0 WHEN observations >= 8 THEN 1e0 ELSE CAST(format('{:.3f}', log2(observations) / 3e0) AS DOUBLE) END * 0.25e0
  + CASE structural WHEN 'gtin_valid' THEN 1e0 WHEN 'gtin_invalid' THEN 0.05e0 WHEN 'other_valid' THEN 0.8e0 ELSE 0.2e0 END * 0.25e0 + CASE s.format WHEN 'EAN-13' THEN 1e0 WHEN 'UPC-A' THEN 0.85e0 WHEN 'Code 128' THEN 0.8e0 END * 0.12e0 + 0e0 * 0.03e0"""


def _conf(obs: str = "observations") -> str:
    return f"""{_groups(obs)},
s AS (SELECT *, CASE WHEN {_GTIN} THEN 'gtin' ELSE 'other' END || CASE WHEN {_valid()} THEN '_valid' ELSE '_invalid' END AS structural FROM h),
c AS (SELECT s.*, CAST(round(CAST(format('{{:.3f}}', {_SCORE.replace('{:.3f}', '{{:.3f}}')}) AS DOUBLE) * 1000) AS INT) AS confidence, s.{_GTIN} AS is_retail, regexp_matches(s.value, '^890[0-9]{{10}}$') AS is_indian FROM s),
r AS (SELECT *, CAST(CASE WHEN is_retail THEN 10000 ELSE 0 END + confidence + least(observations, 12) * 10 AS BIGINT) AS rank_score FROM c),
q AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rank_score DESC, first_ord, payload) AS position FROM r),
t AS (SELECT * REPLACE (row_number() OVER (PARTITION BY image_id ORDER BY position) AS position) FROM (SELECT *, first(confidence) OVER (PARTITION BY image_id ORDER BY position) AS lead FROM q) WHERE confidence / 1000.0::DOUBLE >= lead / 1000.0::DOUBLE * 0.6::DOUBLE)"""


_TIER = f"CASE WHEN is_retail THEN 0 WHEN format = 'Code 128' THEN 1 WHEN format NOT IN ({_in(dims.TWO_D_FORMATS)}) THEN 2 ELSE 3 END"
_GROUPS, _CONF = _groups(), _conf().replace("{{:.3f}}", "{:.3f}")


def _obs(spark, sf_dir):
    return view(spark, sf_dir, "observations")


@query(f"SELECT image_id, ord, {_check('value')} AS valid FROM observations", V)
def gtin_validate(spark, sf_dir):
    return _obs(spark, sf_dir).select("image_id", "ord", fmt.check_digit_ok(F.col("value")).alias("valid"))


@query(f"SELECT image_id, ord, CASE WHEN {_GTIN} THEN 'gtin' WHEN format IN ({_in(dims.NUMERIC_FORMATS)}) THEN 'numeric_code' ELSE 'binary_or_unknown' END AS kind, {_valid()} AS valid FROM observations", V)
def payload_validate(spark, sf_dir):
    v, f = F.col("value"), F.col("format")
    return _obs(spark, sf_dir).select("image_id", "ord", fmt.payload_kind(f).alias("kind"), fmt.payload_valid(v, f).alias("valid"))


_ALIASES = ", ".join(f"('{k}', '{v}')" for k, v in dims.FORMAT_ALIASES.items())
_RAW = [*dims.FORMAT_ALIASES, "nothing"]


@query(f"SELECT l_orderkey, l_linenumber, coalesce(v.name, 'UNKNOWN') AS format FROM (SELECT *, [{_in(_RAW)}][CAST(l_partkey % {len(_RAW)} AS BIGINT) + 1] AS raw FROM lineitem) l LEFT JOIN (VALUES {_ALIASES}) v(raw, name) ON v.raw = l.raw")
def format_normalise(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    raw = F.get(F.array(*[F.lit(r) for r in _RAW]), (F.col("l_partkey") % len(_RAW)).cast("int"))
    return li.select("l_orderkey", "l_linenumber", fmt.normal_format(raw).alias("format"))


@query(f"WITH {_GROUPS} SELECT image_id, payload, value, engines, variants, observations, CAST(agreement AS INT) AS agreement, fastest_ms FROM h", V)
def fusion_groups(spark, sf_dir):
    g = fusion.groups(_obs(spark, sf_dir))
    return g.select("image_id", "payload", "value", F.array_join("engines", ",").alias("engines"), F.array_join("variants", ",").alias("variants"), "observations", "agreement", "fastest_ms")


@query(f"WITH {_GROUPS} SELECT image_id, payload, format, formats FROM h", V)
def format_reconcile(spark, sf_dir):
    return fusion.groups(_obs(spark, sf_dir)).select("image_id", "payload", "format", F.array_join("formats", ",").alias("formats"))


@query(f"WITH {_CONF} SELECT image_id, payload, structural, confidence, is_retail, is_indian FROM c", V)
def fusion_confidence(spark, sf_dir):
    return fusion.with_confidence(fusion.groups(_obs(spark, sf_dir))).select("image_id", "payload", "structural", "confidence", "is_retail", "is_indian")


@query(f"WITH {_CONF} SELECT image_id, payload, rank_score, CAST(position AS INT) AS position FROM q", V)
def fusion_ranked(spark, sf_dir):
    return fusion.ranked(_obs(spark, sf_dir)).select("image_id", "payload", F.col("rank_score").cast("bigint").alias("rank_score"), "position")


@query(f"WITH {_CONF} SELECT image_id, payload, confidence, CAST(position AS INT) AS position FROM t WHERE position <= 5", V)
def fusion_topk_cutoff(spark, sf_dir):
    return fusion.kept(fusion.ranked(_obs(spark, sf_dir))).select("image_id", "payload", "confidence", "position")


@query(f"WITH {_CONF} SELECT image_id, arg_min(value, ({_TIER}, position)) AS value, arg_min(format, ({_TIER}, position)) AS format, arg_min(confidence, ({_TIER}, position)) AS confidence, min({_TIER}) AS tier FROM t WHERE position <= 5 GROUP BY image_id", V)
def primary_barcode(spark, sf_dir):
    return fusion.primary(fusion.kept(fusion.ranked(_obs(spark, sf_dir)))).select("image_id", "value", "format", "confidence", "tier")


@query(
    f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord, value, engine) AS k FROM observations), z AS (SELECT b.image_id * 100000 + a.k AS image_id, b.* EXCLUDE (image_id) FROM b JOIN (SELECT image_id AS i, k FROM b) a ON b.image_id = a.i AND b.k <= a.k),
{_conf("z").replace("{{:.3f}}", "{:.3f}")}, l AS (SELECT image_id // 100000 AS image, image_id % 100000 AS k, arg_min(confidence, ({_TIER}, position)) AS sure, arg_min(agreement, ({_TIER}, position)) AS agreed, arg_min(is_retail, ({_TIER}, position)) AS retail FROM t WHERE position <= 5 GROUP BY image_id),
w AS (SELECT image, min(k) AS k, arg_min(sure >= 850, k) AS strong FROM l WHERE sure >= 850 OR (agreed >= 2 AND retail) GROUP BY image), n AS (SELECT image_id, count(*) AS n FROM observations GROUP BY image_id)
SELECT image_id, CAST(coalesce(w.k, n.n) AS INT) AS steps, CASE WHEN w.k IS NULL THEN 'variant_budget_exhausted' WHEN strong THEN 'confidence_target_reached' ELSE 'multi_engine_agreement' END AS reason FROM n LEFT JOIN w ON w.image = n.image_id""",
    V,
)
def early_stop_prefix(spark, sf_dir):
    return fusion.stops(_obs(spark, sf_dir))


_LOOKUP = f"CASE min({_TIER}) WHEN 0 THEN 'retail_gtin' WHEN 1 THEN 'code_128' WHEN 2 THEN 'other_1d' ELSE 'fallback_first' END"


@query(
    f"""WITH {_CONF}, s2 AS (SELECT image_id, arg_min(value, ({_TIER}, position)) AS value, arg_min(confidence, ({_TIER}, position)) AS confidence, arg_min(is_retail, ({_TIER}, position)) AS retail, {_LOOKUP} AS selection FROM t WHERE position <= 5 GROUP BY image_id)
SELECT k.image_id, CASE WHEN k.image_id % 10 = 7 THEN 'not_attempted' WHEN s2.image_id IS NULL THEN 'no_barcode' WHEN confidence < 500 THEN 'low_confidence' ELSE 'detected' END AS state,
  CASE WHEN k.image_id % 10 <> 7 AND confidence >= 500 THEN value END AS value, k.image_id % 10 <> 7 AND coalesce(confidence >= 500 AND retail, false) AS usable, CASE WHEN k.image_id % 10 <> 7 THEN selection END AS selection, CASE WHEN k.image_id % 10 <> 7 AND retail IS NOT NULL THEN CASE WHEN retail THEN 'gtin' ELSE 'other' END END AS key_kind
FROM (SELECT DISTINCT l_orderkey % 4000 AS image_id FROM lineitem) k LEFT JOIN s2 USING (image_id)""",
    V,
)
def detection_state(spark, sf_dir):
    """What can be told of every image; images of which the last digit is 7 stand for those that no engine looked at."""
    seen = fusion.primary(fusion.kept(fusion.ranked(_obs(spark, sf_dir))))
    images = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") % 4000).alias("image_id")).distinct().withColumn("engines", F.when(F.col("image_id") % 10 == 7, 0).otherwise(3))
    return fusion.detection_states(images, seen).select("image_id", "state", "value", "usable", "selection", "key_kind")


@query("SELECT l_orderkey % 3000 AS image_id, CASE l_linenumber % 3 WHEN 0 THEN 'ZBar' WHEN 1 THEN 'ZXing-C++' ELSE 'ZXing' END AS engine, count(DISTINCT l_returnflag || l_linestatus) AS variants_tried, count(*) AS detections, CAST(sum(floor(l_quantity)) AS DOUBLE) AS total_ms FROM lineitem GROUP BY ALL")
def engine_attempts(spark, sf_dir):
    return fusion.engine_attempts(_obs(spark, sf_dir))


@query("""WITH e AS (SELECT image_id, trim(value) AS payload, engine, max(decode_ms) AS score FROM observations GROUP BY ALL) SELECT image_id, payload, string_agg(engine || '=' || CASE WHEN engine = 'ZBar' THEN '' ELSE CAST(score AS VARCHAR) END, ',' ORDER BY engine) AS scores FROM e GROUP BY ALL""", V)
def engine_scores(spark, sf_dir):
    """Every engine of a candidate with its own score; ZBar gives none."""
    o = _obs(spark, sf_dir).withColumn("engine_confidence", F.when(F.col("engine") != "ZBar", F.col("decode_ms").cast("double")))
    g = fusion.engine_scores(o)
    return g.select("image_id", "payload", F.array_join(F.transform("scores", lambda s: F.concat(s["engine"], F.lit("="), F.coalesce(s["confidence"].cast("int").cast("string"), F.lit("")))), ",").alias("scores"))


@query(
    """SELECT id, CASE WHEN event_id_hits IS NULL THEN 'miss' WHEN expected = '' OR list_contains(event_id_hits, expected) THEN 'correct' ELSE 'incorrect' END AS classification FROM
(SELECT event_id AS id, CASE WHEN event_id % 10 < 8 THEN [CAST(event_id % 7 AS VARCHAR), CAST(user_id % 5 AS VARCHAR)] END AS event_id_hits, CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(user_id % 3 AS VARCHAR) END AS expected FROM events)"""
)
def image_classification(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    values = F.when(F.col("event_id") % 10 < 8, F.array((F.col("event_id") % 7).cast("string"), (F.col("user_id") % 5).cast("string")))
    expected = F.when(F.col("event_id") % 4 != 0, (F.col("user_id") % 3).cast("string")).otherwise(" ")
    return e.select(F.col("event_id").alias("id"), fusion.image_class(values, expected).alias("classification"))


@query(f"WITH {_CONF}, pr AS (SELECT image_id, arg_min(trim(value), ({_TIER}, position)) AS value FROM t WHERE position <= 5 GROUP BY image_id), e AS (SELECT image_id, arg_min(trim(value), (ord, value)) AS expected FROM observations GROUP BY 1) SELECT count(*) AS images, count(*) FILTER (value = expected) AS correct, count(*) FILTER (value IS NULL) AS missed FROM e LEFT JOIN pr USING (image_id)", V)
def fusion_accuracy(spark, sf_dir):
    o = _obs(spark, sf_dir)
    truth = o.groupBy("image_id").agg(F.min_by(F.trim("value"), F.struct("ord", "value")).alias("expected"))
    p = fusion.primary(fusion.kept(fusion.ranked(o))).withColumn("value", F.trim("value"))
    return fusion.accuracy(p, truth)


# --- URLs and addresses ---


@query(
    """WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS host FROM pages)
SELECT page_id, host, CASE WHEN url IS NULL OR trim(url) = '' THEN 'VALIDATION_ERROR' WHEN length(url) > 2048 OR scheme = '' THEN 'INVALID_URL' WHEN scheme NOT IN ('http', 'https') THEN 'UNSUPPORTED_SCHEME' WHEN host = '' THEN 'INVALID_URL' WHEN scheme = 'http' THEN 'UNSUPPORTED_SCHEME' END AS error FROM u"""
)
def url_policy(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", net.url_parts(F.trim("url"))["host"].alias("host"), net.url_verdict("url").alias("error"))


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '') AS tag FROM pages")
def url_redact(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", net.redacted(F.col("url")).alias("tag"))


_HOSTS = ("example.com", "example.org")


@query("SELECT page_id FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h FROM pages) WHERE h IN ('example.com', 'example.org') OR ends_with(h, '.example.com') OR ends_with(h, '.example.org')")
def host_allowlist(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.filter(net.host_listed(net.url_parts(F.col("url"))["host"], _HOSTS)).select("page_id")


_IP = "CAST(c_custkey * 37 % 256 AS STRING) || '.' || CAST(c_custkey * 11 % 260 AS STRING) || '.' || CAST(c_custkey % 7 AS STRING) || '.' || CAST(c_custkey % 200 AS STRING)"
_BLOCK_SQL = """WHEN a = 0 THEN 'blocked address range 0.0.0.0/8 (unspecified address)' WHEN a = 10 THEN 'blocked address range 10.0.0.0/8 (private network (RFC1918))' WHEN a = 100 AND b BETWEEN 64 AND 127 THEN 'blocked address range 100.64.0.0/10 (carrier-grade NAT (RFC6598))'
  WHEN a = 127 THEN 'blocked address range 127.0.0.0/8 (loopback)' WHEN a = 169 AND b = 254 THEN 'blocked address range 169.254.0.0/16 (link-local / cloud metadata (169.254.169.254))' WHEN a = 172 AND b BETWEEN 16 AND 31 THEN 'blocked address range 172.16.0.0/12 (private network (RFC1918))'
  WHEN a = 192 AND b = 0 AND c = 0 THEN 'blocked address range 192.0.0.0/24 (IETF protocol assignments)' WHEN a = 192 AND b = 0 AND c = 2 THEN 'blocked address range 192.0.2.0/24 (documentation range (TEST-NET-1))' WHEN a = 192 AND b = 168 THEN 'blocked address range 192.168.0.0/16 (private network (RFC1918))'
  WHEN a = 198 AND b IN (18, 19) THEN 'blocked address range 198.18.0.0/15 (benchmarking range)' WHEN a = 198 AND b = 51 AND c = 100 THEN 'blocked address range 198.51.100.0/24 (documentation range (TEST-NET-2))' WHEN a = 203 AND b = 0 AND c = 113 THEN 'blocked address range 203.0.113.0/24 (documentation range (TEST-NET-3))'
  WHEN a BETWEEN 224 AND 239 THEN 'blocked address range 224.0.0.0/4 (multicast)' WHEN a >= 240 THEN 'blocked address range 240.0.0.0/4 (reserved (includes 255.255.255.255 broadcast))'"""


@query(f"WITH i AS (SELECT c_custkey, {_IP} AS ip, c_custkey * 37 % 256 AS a, c_custkey * 11 % 260 AS b, c_custkey % 7 AS c FROM customer) SELECT c_custkey, ip, CASE WHEN b > 255 THEN 'unparseable IPv4 address' {_BLOCK_SQL} END AS reason FROM i")
def ipv4_classify(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", f"{_IP} AS ip")
    return c.select("c_custkey", "ip", net.ip_reason(F.col("ip")).alias("reason"))


_IP6 = ["::1", "::", "fe80::1", "fc00::1", "fd12:3456::1", "ff02::1", "2001:db8::5", "2606:4700:4700::1111", "::ffff:127.0.0.1", "::ffff:8.8.8.8", "1:2:3", "100::1"]
_IP6_WHY = ["loopback", "unspecified address", "link-local", "unique local address (fc00::/7)", "unique local address (fc00::/7)", "multicast", "documentation range", None, "blocked address range 127.0.0.0/8 (loopback)", None, "unparseable IPv6 address", "discard prefix (100::/64)"]


@query(
    f"SELECT c_custkey, v.ip, v.reason FROM customer JOIN (VALUES {', '.join(f'({i}, {ip!r}, ' + ('NULL' if w is None else repr(w)) + ')' for i, (ip, w) in enumerate(zip(_IP6, _IP6_WHY)))}) v(k, ip, reason) ON c_custkey % {len(_IP6)} = v.k"
)
def ipv6_classify(spark, sf_dir):
    ip = F.get(F.array(*[F.lit(i) for i in _IP6]), (F.col("c_custkey") % len(_IP6)).cast("int"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", ip.alias("ip"))
    return c.select("c_custkey", "ip", net.ip_reason(F.col("ip")).alias("reason"))
