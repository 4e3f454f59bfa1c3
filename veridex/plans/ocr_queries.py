"""Queries over recognised text and image limits, with their SQL. Rows of the tables stand for words, lines and passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridex.functions import net
from veridex.operators import ocr
from veridex.plans.registry import query


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """WITH w AS (SELECT l_orderkey AS image_id, l_linenumber * 10 AS y0, l_linenumber * 10 + 8 AS y1, CASE WHEN l_linenumber = 5 THEN 0 ELSE floor(l_quantity) END AS c FROM lineitem), b AS (SELECT o_orderkey AS image_id, 10 * (o_orderkey % 3) AS y, 45 AS height FROM orders),
g AS (SELECT b.image_id, count(c) AS n, sum(c) AS s, count(*) FILTER (y0 >= y AND y1 <= y + height) AS n_in, sum(c) FILTER (y0 >= y AND y1 <= y + height) AS s_in FROM b LEFT JOIN w USING (image_id) GROUP BY ALL)
SELECT image_id, CASE WHEN n_in >= 3 THEN n_in ELSE n END AS words, CASE WHEN n_in >= 3 THEN (200 * CAST(s_in AS BIGINT) + n_in) // (2 * n_in) / 100e0 WHEN n > 0 THEN (200 * CAST(s AS BIGINT) + n) // (2 * n) / 100e0 END AS confidence FROM g"""
)
def word_confidence(spark, sf_dir):
    n = F.col("l_linenumber")
    words = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), (n * 10).alias("y0"), (n * 10 + 8).alias("y1"), F.when(n == 5, float("nan")).otherwise(F.floor("l_quantity").cast("double")).alias("confidence"))
    bands = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit("all").alias("band"), (F.col("o_orderkey") % 3 * 10).alias("y"), F.lit(45).alias("height"))
    return ocr.mean_confidences(words, bands).select("image_id", "words", "confidence")


@query("SELECT l_orderkey AS image_id, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity / 10), l_partkey, l_linenumber) - 1 AS position FROM lineitem WHERE l_linenumber <> 6")
def line_order(spark, sf_dir):
    text = F.when(F.col("l_linenumber") == 6, " \t ").otherwise(F.concat(F.lit(" "), F.col("l_linenumber").cast("string")))
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.floor(F.col("l_quantity") / 10).alias("y0"), F.col("l_partkey").alias("x0"), text.alias("text"))
    return ocr.ordered_lines(lines).select("image_id", F.col("text").cast("int").alias("line"), F.col("position").cast("bigint").alias("position"))


@query(
    r"""WITH p AS (SELECT doc_id // 5 AS image_id, doc_id % 5 AS pass, trim(CASE WHEN doc_id % 7 = 0 THEN 'Ingredients: ' WHEN doc_id % 7 = 1 THEN 'NUTRITIONAL ' ELSE '' END || substr(text, 1, 80 + 40 * CAST(doc_id % 3 AS BIGINT)), ' ') AS t, doc_id % 100 AS conf FROM documents WHERE doc_id % 5 < 4),
q AS (SELECT *, regexp_matches(t, '\b(ingredients?|composition|made\s+from|prepared\s+from)\b', 'i') AS ing, regexp_matches(t, '\bnutrition(al)?\b', 'i') AS nut FROM p),
s AS (SELECT *, CAST(format('{:.4f}', (CASE WHEN ing THEN 1e0 ELSE 0e0 END + CASE WHEN nut THEN 1e0 ELSE 0e0 END * 0.3e0) * 2 + least(1e0, length(t) / 1200e0) + conf / 100e0) AS DOUBLE) AS score, coalesce(bool_or(ing AND length(t) > 120) OVER (PARTITION BY image_id ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM q)
SELECT image_id, arg_min(pass, (-score, pass)) AS pass, max(score) AS score, count(*) AS passes, bool_or(ing AND length(t) > 120) AS stopped_early FROM s WHERE NOT over GROUP BY image_id"""
)
def pass_choice(spark, sf_dir):
    """Texts of five neighbouring documents stand for the passes over an image, with headings put before some of them."""
    d, i = _table(spark, sf_dir, "documents"), F.col("doc_id")
    head = F.when(i % 7 == 0, "Ingredients: ").when(i % 7 == 1, "NUTRITIONAL ").otherwise("")
    passes = d.select(F.floor(i / 5).cast("bigint").alias("image_id"), (i % 5).alias("pass"), F.concat(head, F.substr("text", F.lit(1), (80 + 40 * (i % 3)).cast("int"))).alias("text"), (i % 100).alias("confidence"))
    return ocr.best_passes(passes, 9)


@query(
    """WITH b AS (SELECT c_nationkey AS image_id, c_custkey AS ord, c_mktsegment || ' ' || c_name AS text FROM customer), h AS (SELECT n_nationkey AS image_id, v.heading FROM nation, (VALUES ('Machinery'), ('BUILDING customer#000'), ('abc'), ('none of all')) v(heading)),
j AS (SELECT h.*, ord, list_sum(list_transform(range(1, least(length(heading), 24) + 1), lambda i: CASE WHEN substr(lower(heading), CAST(i AS BIGINT), 1) = substr(lower(text), CAST(i AS BIGINT), 1) THEN 1 ELSE 0 END)) AS same, contains(lower(substr(text, 1, 120)), lower(substr(heading, 1, 10))) AND length(heading) > 3 AS has FROM h LEFT JOIN b USING (image_id))
SELECT image_id, heading, CASE WHEN max(CASE WHEN has THEN same ELSE 0 END) > 0 THEN arg_min(ord, (-CASE WHEN has THEN same ELSE 0 END, ord)) END AS ord, CAST(coalesce(max(CASE WHEN has THEN same ELSE 0 END), 0) AS INT) AS score FROM j GROUP BY ALL"""
)
def heading_blocks(spark, sf_dir):
    """Names of customers stand for the blocks of their nation's image."""
    blocks = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image_id"), F.col("c_custkey").alias("ord"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("text"))
    names = F.explode(F.array(*[F.lit(h) for h in ("Machinery", "BUILDING customer#000", "abc", "none of all")]))
    headings = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("image_id"), F.lit("any").alias("kind"), names.alias("heading"))
    return ocr.heading_blocks(headings, blocks).select("image_id", "heading", "ord", "score")


@query("SELECT p_partkey, CASE WHEN p_size % 10 = 0 OR p_partkey = 0 THEN 'INVALID_IMAGE' WHEN p_size * 100 > 4000 OR p_size * 100 * p_partkey > 1000000 OR p_partkey > 4000 THEN 'IMAGE_TOO_LARGE' END AS error FROM part")
def image_limits(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 10 == 0, 0).otherwise(F.col("p_size") * 100).alias("w"), F.col("p_partkey").alias("h"))
    return p.select("p_partkey", ocr.over_limits("w", "h", 4000, 1_000_000).alias("error"))


@query("SELECT o_custkey, CAST(floor(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*) + 0.5) AS INT) AS percent FROM orders GROUP BY o_custkey UNION ALL SELECT -1, 0")
def progress(spark, sf_dir):
    g = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count("*").alias("total"))
    none = spark.sql("SELECT -1L AS o_custkey, 0L AS done, 0L AS total")
    return g.unionByName(none).select("o_custkey", ocr.progress(F.col("done"), F.col("total")).alias("percent"))


@query(
    """WITH a AS (SELECT n_nationkey, count(c_custkey) AS n, count(*) FILTER (c_custkey % 50 = 0) AS bad FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey)
SELECT n_nationkey, CASE WHEN n = 0 THEN 'no address' WHEN bad > 0 THEN 'blocked address range 10.0.0.0/8 (private network (RFC1918))' END AS reason FROM a"""
)
def all_addresses(spark, sf_dir):
    """A host is refused for the first of its addresses that is; customers stand for the addresses of their nation."""
    ip = F.concat(F.when(F.col("c_custkey") % 50 == 0, "10.1.2.").otherwise("8.8.8."), (F.col("c_custkey") % 200).cast("string"))
    found = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set(ip)).alias("addresses"))
    hosts = _table(spark, sf_dir, "nation").join(found, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return hosts.select("n_nationkey", net.addresses_reason(F.col("addresses")).alias("reason"))
