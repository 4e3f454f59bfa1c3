"""Queries over a second kind of label, with nested lists, all kinds of sections and faults, and over whole analyses; with their SQL.

What the SQL says of the labels is worked out by hand from how the view makes them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veridex.operators import fusion, labels, responses
from veridex.plans.code_queries import _CONF, _TIER, _obs
from veridex.plans.registry import query
from veridex.sources.views import view

#: Where things stand on a label: i when it has ingredients, then the lines of its nutrition section's begin and end.
_AT = "k AS (SELECT p_partkey AS k, p_partkey % 4 <> 1 AS i, CASE WHEN p_partkey % 4 <> 1 THEN 9 ELSE 3 END AS b, CASE WHEN p_partkey % 4 <> 1 THEN 9 ELSE 3 END + CASE WHEN p_partkey % 6 = 1 THEN 2 ELSE 6 END AS e FROM part)"
#: Sections after the nutrition: kind, lines from its end to the begin and to the end.
_AFTER = "('allergens', 3, 4), ('contains', 4, 4), ('storage', 5, 5), ('usage', 8, 8), ('manufacturer', 11, 11), ('fssai', 12, 15), ('mrp', 13, 16), ('net_quantity', 14, 16), ('best_before', 15, 16), ('claims', 16, 16)"


def _rich(spark, sf_dir):
    return view(spark, sf_dir, "rich_labels")


@query(
    f"""WITH {_AT}, s AS (SELECT k, 'ingredients' AS kind, 3 AS a, 3 AS z FROM k WHERE i UNION ALL SELECT k, 'ingredients_continued', 6, 6 FROM k WHERE i UNION ALL SELECT k, 'nutrition', b, e FROM k UNION ALL SELECT k, v.kind, e + v.f, e + v.t FROM k, (VALUES {_AFTER}) v(kind, f, t))
SELECT kind, count(*) AS n, CAST(sum(a) AS BIGINT) AS first_lines, CAST(sum(z) AS BIGINT) AS last_lines FROM s GROUP BY kind"""
)
def section_kinds(spark, sf_dir):
    """All thirteen kinds of sections, and on which lines they stand."""
    s = labels.found_sections(_rich(spark, sf_dir))
    return s.groupBy("kind").agg(F.count("*").alias("n"), F.sum("start_line").alias("first_lines"), F.sum("end_line").alias("last_lines"))


_ITEMS = """('0', 'Ingredients: Potato', NULL), ('1', 'Refined Oil (Palm Oil, Soybean Oil (Antioxidant (INS 319, INS 320)))', 'INS 319'), ('1/0', 'Palm Oil', NULL), ('1/1', 'Soybean Oil (Antioxidant (INS 319, INS 320))', 'INS 319'), ('1/1/0', 'Antioxidant (INS 319, INS 320)', 'INS 319'),
('1/1/0/0', 'INS 319', 'INS 319'), ('1/1/0/1', 'INS 320', 'INS 320')"""


@query(
    f"""WITH v(path, raw, code) AS (VALUES {_ITEMS}), c(kind, path, raw) AS (VALUES (0, '2', 'Spices (Chilli, Salt)'), (0, '2/0', 'Chilli'), (0, '2/1', 'Salt'), (1, '2', 'Spices (Chilli, Salt'), (1, '2/0', 'Chilli, Salt'))
SELECT p_partkey AS doc_id, path, CAST(length(path) - length(replace(path, '/', '')) AS INT) AS depth, raw, code, CASE WHEN starts_with(path, '1') AND path <> '1/0' AND NOT starts_with(path, '1/1/0') THEN 'soy' ELSE '' END AS allergens FROM part, v WHERE p_partkey % 4 <> 1
UNION ALL SELECT p_partkey, path, CAST(length(path) - length(replace(path, '/', '')) AS INT), raw, NULL, '' FROM part, c WHERE p_partkey % 4 <> 1 AND kind = CAST(p_partkey % 4 = 2 AS INT)"""
)
def nested_ingredients(spark, sf_dir):
    """Lists three levels deep; one whose parenthesis never closes keeps what follows in one item."""
    items = labels.ingredient_items(_rich(spark, sf_dir))
    path = F.array_join(F.transform("path", lambda p: p.cast("string")), "/")
    return items.select("doc_id", path.alias("path"), "depth", "raw", "code", F.array_join("allergens", ",").alias("allergens"))


@query("SELECT p_partkey AS doc_id, 'parenthesis at 98 never closes' AS error FROM part WHERE p_partkey % 4 = 2")
def ingredient_errors(spark, sf_dir):
    return labels.ingredient_errors(_rich(spark, sf_dir))


@query(
    """SELECT p_partkey AS doc_id, 'Sunrise Masala Chips' AS name, 'Sunrise' AS brand, CASE p_partkey % 3 WHEN 0 THEN 'Chilli' WHEN 1 THEN 'Lime' END AS variant_or_flavour, 'Golden Foods, Plot ' || (p_partkey % 7) AS manufacturer, '200 g' AS net_quantity, '55 INR' AS mrp,
  CAST(10012051000000 + p_partkey AS VARCHAR) AS fssai_license, CAST(NULL AS VARCHAR) AS country_of_origin FROM part"""
)
def product_details(spark, sf_dir):
    """Makers, brands and flavours."""
    p = labels.products(_rich(spark, sf_dir))
    names = ["name", "brand", "variant_or_flavour", "manufacturer", "net_quantity", "mrp", "fssai_license", "country_of_origin"]
    return p.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names])


@query(
    """SELECT p_partkey AS doc_id, 'per 30 g' AS basis, CASE WHEN p_partkey % 2 = 0 THEN '4 piece' END AS serving_size, CASE WHEN p_partkey % 6 = 1 THEN '' ELSE 'energy=' || (100 + p_partkey % 50) || '.0,protein=6.5,total_fat=' || (p_partkey % 9) || '.0' END AS readings,
  CASE WHEN p_partkey % 6 = 1 THEN 'qqq zzz' ELSE 'Mystery 5' END || '|' || CASE WHEN p_partkey % 2 = 0 THEN 'Serves about 4 piece' ELSE 'Vitamin trace' END AS lost, CASE WHEN p_partkey % 6 <> 1 THEN 662 END::INT AS confidence FROM part"""
)
def nutrition_panels(spark, sf_dir):
    """Basis and serving size as printed, the first reading of each nutrient, lines that nobody could read, confidence."""
    p = labels.panels(_rich(spark, sf_dir))
    readings = F.array_join(F.transform("values", lambda v: F.concat(v["nutrient"], F.lit("="), v["value"].cast("string"))), ",")
    return p.select("doc_id", "basis", "serving_size", readings.alias("readings"), F.array_join("undeciphered_lines", "|").alias("lost"), "confidence")


@query("SELECT p_partkey AS doc_id, raw, start FROM part, (VALUES ('ﬁ', 42), ('–', 52), ('“', 56), ('”', 62)) v(raw, start) WHERE p_partkey % 3 = 2")
def unicode_edits(spark, sf_dir):
    """Typographic letters that the repair replaced, all of a label."""
    return labels.folded_letters(_rich(spark, sf_dir)).select("doc_id", "raw", "start")


def _responses(spark, sf_dir):
    kept = fusion.kept(fusion.ranked(_obs(spark, sf_dir)))
    codes = responses.barcodes(kept, fusion.primary(kept), fusion.engine_attempts(_obs(spark, sf_dir)))
    return responses.responses(view(spark, sf_dir, "requests"), _rich(spark, sf_dir), codes)


_SEEN = """rq AS (SELECT *, run_barcode AND NOT barcode_failed AS looked, ocr AND ocr_enabled AS run, ocr AND ocr_enabled AND ocr_left_ms >= 1000 AS started, ocr AND ocr_enabled AND ocr_left_ms >= 1000 AND NOT ocr_failed AS told FROM requests)"""
_WARNED = """array_to_string(list_filter([CASE WHEN ocr AND NOT ocr_enabled THEN 'ocr_disabled_by_configuration' END, CASE WHEN downscaled THEN 'image_downscaled_for_processing' END, CASE WHEN orientation_applied THEN 'exif_orientation_applied' END,
  CASE WHEN quality = 'poor' THEN 'low_image_quality' END, CASE WHEN NOT run_barcode THEN 'barcode_skipped_by_request' END, CASE WHEN run_barcode AND barcode_failed THEN 'barcode_stage_failed' END, CASE WHEN looked AND pc.image_id IS NULL THEN 'barcode_not_detected' END,
  CASE WHEN run AND NOT started THEN 'ocr_skipped_request_budget_exhausted' END, CASE WHEN started AND ocr_cap_failed THEN 'ocr_raster_cap_failed' END, CASE WHEN started AND ocr_failed THEN 'ocr_stage_failed' END,
  CASE WHEN NOT told OR doc_id % 4 = 1 THEN 'ingredient_list_not_found' END, CASE WHEN told AND doc_id % 6 = 1 THEN 'nutrition_section_found_but_unreadable' END], lambda w: w IS NOT NULL), ',')"""


@query(
    f"""WITH {_CONF}, pc AS (SELECT image_id, arg_min(value, ({_TIER}, position)) AS value, count(*) AS n FROM t WHERE position <= 5 GROUP BY image_id), {_SEEN}
SELECT doc_id, {_WARNED} AS warnings, looked AND pc.image_id IS NOT NULL AS detected, CASE WHEN looked THEN pc.value END AS value, CASE WHEN looked THEN coalesce(pc.n, 0) ELSE 0 END::INT AS results,
  CASE WHEN told AND doc_id % 4 <> 1 THEN 10 - CAST(doc_id % 4 = 2 AS INT) ELSE 0 END AS items, CASE WHEN told THEN 'Sunrise' END AS brand, told AS shown FROM rq LEFT JOIN pc ON pc.image_id = rq.doc_id""",
    ("observations", "requests"),
)
def analysis_responses(spark, sf_dir):
    """The response document of every request, read back: its warnings, codes, items and fields."""
    schema = """barcode struct<detected boolean, primary struct<value string>, results array<struct<value string>>>, ingredients struct<items array<struct<path array<int>>>>, product map<string, struct<value string>>, ocr struct<detected boolean>, warnings array<string>"""
    r = _responses(spark, sf_dir).select("doc_id", F.from_json("response", schema).alias("d"))
    return r.select(
        "doc_id", F.array_join("d.warnings", ",").alias("warnings"), "d.barcode.detected", F.col("d.barcode.primary.value").alias("value"), F.coalesce(F.size("d.barcode.results"), F.lit(0)).alias("results"),
        F.greatest(F.coalesce(F.size("d.ingredients.items"), F.lit(0)), F.lit(0)).alias("items"), F.col("d.product")["brand"]["value"].alias("brand"), F.col("d.ocr.detected").alias("shown"),
    )


@query(
    f"""WITH {_CONF}, pc AS (SELECT image_id, arg_min({{'v': value, 'f': format, 'c': confidence, 'i': is_indian, 'e': engines}}, ({_TIER}, position)) AS b FROM t WHERE position <= 5 GROUP BY image_id), {_SEEN}, w AS (SELECT doc_id, {_WARNED} AS warned, looked, run_barcode, told, pc.b AS b FROM rq LEFT JOIN pc ON pc.image_id = rq.doc_id)
SELECT doc_id, 'barcode   ' || CASE WHEN looked AND b IS NOT NULL THEN b.v || '  ' || b.f || '  confidence ' || format('{{:.3f}}', b.c / 1000e0) || ' (derived, engines: ' || replace(b.e, ',', ', ') || ')' WHEN NOT run_barcode THEN 'skipped (--text-only)' ELSE 'not detected' END
  || CASE WHEN looked AND b.i THEN chr(10) || '          Indian GS1 prefix (890...)' ELSE '' END || chr(10) || 'ocr       ' || CASE WHEN told THEN 'text detected' ELSE 'no text detected' END
  || chr(10) || 'ingredients ' || CASE WHEN told AND doc_id % 4 <> 1 THEN CASE WHEN doc_id % 4 = 2 THEN '9' ELSE '10' END || ' found' ELSE 'not found' END || CASE WHEN warned <> '' THEN chr(10) || 'warnings  ' || replace(warned, ',', ', ') ELSE '' END AS report FROM w""",
    ("observations", "requests"),
)
def console_reports(spark, sf_dir):
    """What a console shows of every response."""
    return responses.reports(_responses(spark, sf_dir))
