"""Queries over rasters made from the table of vectors, and over image plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridex import dims
from veridex.plans.registry import query
from veridex.raster import frames, pixels
from veridex.sources.views import spread

#: Images of a task: a file of few bytes may hold very many.
ROWS = 1_000


def _rasters(spark, sf_dir):
    return frames.grey_from_vectors(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ROWS))


_G = "g AS (SELECT vec_id AS image_id, unnest(list_transform(embedding[1:64], lambda v: CAST(floor(abs(v::DOUBLE) * 255) AS BIGINT) % 256)) AS t FROM embeddings)"


@query(
    f"""WITH {_G}, h AS (SELECT image_id, t, count(*) * 64 AS n FROM g GROUP BY ALL),
r AS (SELECT image_id, t, sum(n) OVER w AS b, sum(t * n) OVER w AS m, sum(n) OVER a AS tot, sum(t * n) OVER a AS mass FROM h WINDOW w AS (PARTITION BY image_id ORDER BY t), a AS (PARTITION BY image_id)),
s AS (SELECT image_id, t, CASE WHEN tot > b THEN b::DOUBLE * (tot - b) * pow(m::DOUBLE / b - (mass - m)::DOUBLE / (tot - b), 2) ELSE 0 END AS v FROM r)
SELECT image_id, CAST(CASE WHEN max(v) > 0 THEN arg_max(t, (v, -t)) ELSE 127 END AS INT) AS threshold FROM s GROUP BY image_id"""
)
def raster_otsu(spark, sf_dir):
    return frames.otsu_levels(_rasters(spark, sf_dir))


@query()
def raster_quality(spark, sf_dir):
    return frames.with_quality(_rasters(spark, sf_dir))


@query()
def raster_variants(spark, sf_dir):
    return frames.variant_digests(_rasters(spark, sf_dir), dims.VARIANTS, "crc32")


#: Pixels of the same rasters, and windows of 31 by 31 over them as plain sums.
_PX = """px AS (SELECT e.vec_id AS image_id, (c.k // 8) * 8 + i.i AS y, (c.k % 8) * 8 + j.j AS x, CAST(floor(abs(e.embedding[c.k + 1]::DOUBLE) * 255) AS BIGINT) % 256 AS v FROM embeddings e, range(64) c(k), range(8) i(i), range(8) j(j)),
bx AS (SELECT *, sum(v) OVER w AS hs, sum(v * v) OVER w AS hq, count(*) OVER w AS hn FROM px WINDOW w AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)),
b AS (SELECT image_id, y, x, v, CAST(sum(hs) OVER w AS BIGINT) AS total, CAST(sum(hq) OVER w AS BIGINT) AS squares, CAST(sum(hn) OVER w AS BIGINT) AS n FROM bx WINDOW w AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)),
m AS (SELECT *, total::DOUBLE / n AS mean, sqrt(greatest(0e0, squares::DOUBLE / n - total::DOUBLE / n * (total::DOUBLE / n))) AS sd FROM b)"""


def _digest_sql(white: str) -> str:
    return f"WITH {_PX} SELECT image_id, sha256(unhex(string_agg(CASE WHEN {white} THEN 'FFFFFFFF' ELSE '000000FF' END, '' ORDER BY y, x))) AS digest FROM m GROUP BY image_id"


def _digest(rasters, name: str):
    """Of images that fit a task, by the kernel of whole images; the windows over rows of pixels give the same, at a row for each pixel."""
    return frames.variant_digests(rasters, [name], "sha256").select("image_id", F.col("sha256").alias("digest"))


@query(_digest_sql("v > total::DOUBLE / n - 10e0"))
def raster_adaptive(spark, sf_dir):
    return _digest(_rasters(spark, sf_dir), "adaptive_threshold")


@query(_digest_sql("v > mean * (1 + 0.2e0 * (sd / 128e0 - 1))"))
def raster_sauvola(spark, sf_dir):
    return _digest(_rasters(spark, sf_dir), "sauvola")


@query(_digest_sql("v > mean + -0.2e0 * sd"))
def raster_niblack(spark, sf_dir):
    return _digest(_rasters(spark, sf_dir), "niblack")


_TALL = "g AS (SELECT e.vec_id AS image_id, c.k // 8 AS cy, c.k % 8 AS x, CAST(floor(abs(e.embedding[c.k + 1]::DOUBLE) * {scale}) AS BIGINT) % 256 AS v FROM embeddings e, range(64) c(k))"


def _tall(spark, sf_dir, scale: int):
    """Tall images: 8 columns, and 40 rows for each 8 values of a vector. Vectors are dealt by image, so that their pixels need no shuffle."""
    e = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "embedding"), ROWS // 4, "image_id")
    e = e.select("image_id", F.posexplode(F.slice("embedding", 1, 64)).alias("k", "e"))
    v = F.floor(F.abs(F.col("e").cast("double")) * scale) % 256
    rows = e.select("image_id", F.floor(F.col("k") / 8).alias("cy"), (F.col("k") % 8).cast("int").alias("x"), v.cast("int").alias("v"))
    return rows.select("image_id", F.explode(F.sequence(F.col("cy") * 40, F.col("cy") * 40 + 39)).alias("y"), "x", "v")


@query(
    f"""WITH {_TALL.format(scale=1200)}, r AS (SELECT image_id, cy * 40 + i.i AS y, count(*) FILTER (v < 128) AS d FROM g, range(40) i(i) GROUP BY ALL),
s AS (SELECT image_id, y, count(*) OVER w AS n, 20 * sum(d * d) OVER w - sum(d) OVER w * sum(d) OVER w AS spread FROM r WINDOW w AS (PARTITION BY image_id ORDER BY y ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
t AS (SELECT image_id, arg_max(y, (spread, -y)) AS a FROM s WHERE n = 20 GROUP BY image_id)
SELECT image_id, CAST(CASE WHEN least(320, a + 26) - greatest(0, a - 6) < 32 THEN 0 ELSE greatest(0, a - 6) END AS INT) AS top, CAST(CASE WHEN least(320, a + 26) - greatest(0, a - 6) < 32 THEN 320 ELSE least(320, a + 26) END AS INT) AS bottom FROM t"""
)
def raster_roi_bands(spark, sf_dir):
    """The rows in which dark pixels vary most; at 320 rows a band of 20 and 6 more at both sides."""
    return pixels.roi_bands(_tall(spark, sf_dir, 1200))


@query(
    f"""WITH {_TALL.format(scale=8)}, c AS (SELECT a.image_id, a.cy, a.x // 2 AS cx, CAST(a.v <> b.v AS INT) AS n FROM g a JOIN g b ON b.image_id = a.image_id AND b.cy = a.cy AND b.x = a.x + 1 WHERE a.x % 2 = 0),
r AS (SELECT image_id, cy * 20 + i.i AS y, cx, n FROM c, range(20) i(i)), h AS (SELECT image_id, list_sort(list(n))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] AS high FROM r GROUP BY 1),
a AS (SELECT DISTINCT image_id, y FROM r JOIN h USING (image_id) WHERE high > 0 AND n >= high), i AS (SELECT image_id, y, y - row_number() OVER (PARTITION BY image_id ORDER BY y) AS g FROM a),
b AS (SELECT image_id, min(y) AS y, count(*) AS n FROM i GROUP BY image_id, g HAVING count(*) >= 2), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y) AS k FROM b)
SELECT image_id, CAST(k AS INT) AS k, 0 AS x, CAST(y * 2 AS INT) AS y, 8 AS width, CAST(n * 2 AS INT) AS height FROM k WHERE k <= 4"""
)
def raster_text_regions(spark, sf_dir):
    return pixels.text_regions(_tall(spark, sf_dir, 8), cell=2)


@query("SELECT vec_id, count(*) AS n, CAST(sum(t) AS BIGINT) AS total, CAST(sum(t * t) AS BIGINT) AS squares FROM (SELECT vec_id, unnest(list_transform(embedding, lambda v: CAST(floor(abs(v::DOUBLE) * 100) AS BIGINT))) AS t FROM embeddings) GROUP BY vec_id")
def array_moments(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100))
    add = lambda f: F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + f(x))
    return e.select("vec_id", F.size("embedding").cast("bigint").alias("n"), add(lambda x: x).alias("total"), add(lambda x: x * x).alias("squares"))


def variant_plan(name: str, most: int) -> list[str]:
    """The first `most` (at least one) variants of a plan, the original always among them."""
    some = dims.PLANS.get(name, dims.VARIANTS)[: max(1, most)]
    return list(dict.fromkeys(some if "original" in some else ["original", *some]))


def ocr_plan(most: Column) -> tuple[Column, Column]:
    """The first `most` (at least one) variants to read text from, and the ways to segment pages that go with them."""
    some = F.slice(F.array(*[F.lit(v) for v in dims.OCR_PLAN]), F.lit(1), F.greatest(F.lit(1), F.coalesce(most, F.lit(1))).cast("int"))
    return some, F.when(F.size(some) > 1, F.array(F.lit(3), F.lit(6))).otherwise(F.array(F.lit(3)))


@query("SELECT p_partkey AS doc_id, array_to_string((['gray_upscale2x', 'gray', 'clahe', 'adaptive', 'original'])[1:greatest(1, p_partkey % 8 - 1)], ',') AS variants, CASE WHEN p_partkey % 8 > 2 THEN '3,6' ELSE '3' END AS modes FROM part")
def ocr_plans(spark, sf_dir):
    """What is to be read from the image of each request, whose limit of variants goes from -1 to 6."""
    variants, modes = ocr_plan(F.col("p_partkey") % 8 - 1)
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("doc_id"), F.array_join(variants, ",").alias("variants"), F.array_join(F.transform(modes, lambda m: m.cast("string")), ",").alias("modes"))


_PLAN_SQL = ", ".join(f"('{n}', {i}, '{v}')" for n, p in dims.PLANS.items() for i, v in enumerate(p))


@query(f"SELECT plan, CAST(ord AS INT) AS ord, variant FROM (VALUES {_PLAN_SQL}) v(plan, ord, variant) WHERE ord < 6")
def variant_plans(spark, sf_dir):
    rows = [(n, i, v) for n in dims.PLANS for i, v in enumerate(variant_plan(n, 6))]
    return spark.createDataFrame(rows, "plan string, ord int, variant string")


@query("SELECT tier, n::BIGINT AS n FROM (VALUES ('tier1', 4), ('tier2', 5), ('tier3', 7)) v(tier, n)")
def tier_sizes(spark, sf_dir):
    rows = [(t, v) for t, vs in dims.TIERS.items() for v in vs]
    return spark.createDataFrame(rows, "tier string, variant string").groupBy("tier").agg(F.count("*").alias("n"))


@query(
    """SELECT * FROM (VALUES ('VALIDATION_ERROR', 400, false), ('INVALID_URL', 400, false), ('BLOCKED_URL', 400, false), ('UNSUPPORTED_SCHEME', 400, false), ('DOWNLOAD_FAILED', 502, true), ('DOWNLOAD_TIMEOUT', 504, true), ('DOWNLOAD_TOO_LARGE', 413, false),
  ('UNSUPPORTED_MEDIA_TYPE', 415, false), ('INVALID_IMAGE', 400, false), ('IMAGE_TOO_LARGE', 413, false), ('UNAUTHORIZED', 401, false), ('RATE_LIMITED', 429, true), ('NOT_FOUND', 404, false), ('ANALYSIS_FAILED', 500, true), ('INTERNAL_ERROR', 500, true), ('SERVICE_UNAVAILABLE', 503, true)) v(code, status, retryable)"""
)
def error_codes(spark, sf_dir):
    e = spark.createDataFrame(list(dims.ERROR_STATUS.items()), "code string, status int")
    return e.withColumn("retryable", (F.col("status") == 429) | (F.col("status") >= 500))
