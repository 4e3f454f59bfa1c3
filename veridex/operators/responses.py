"""Whole analyses: what a request found in codes and in text, its warnings, and the response document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.operators import labels as L

OCR_LEAST_MS = 1000
#: Texts of a task that reads them.
TEXTS = 5_000


def text_was_read() -> Column:
    """Whether a request's text was read at all: wanted, enabled, with time left, and not failed."""
    return F.col("ocr") & F.col("ocr_enabled") & (F.col("ocr_left_ms") >= OCR_LEAST_MS) & ~F.col("ocr_failed")


def warnings(detected: Column, no_ingredients: Column, unreadable_panel: Column) -> Column:
    """The warnings of a request, in the order of its stages.

    Columns of the request: downscaled, orientation_applied, quality, run_barcode, barcode_failed, ocr (wanted),
    ocr_enabled, ocr_left_ms, ocr_cap_failed, ocr_failed.
    """
    run = F.col("ocr") & F.col("ocr_enabled")
    started = run & (F.col("ocr_left_ms") >= OCR_LEAST_MS)
    rules = [
        (F.col("ocr") & ~F.col("ocr_enabled"), "ocr_disabled_by_configuration"), (F.col("downscaled"), "image_downscaled_for_processing"), (F.col("orientation_applied"), "exif_orientation_applied"),
        (F.col("quality") == "poor", "low_image_quality"), (~F.col("run_barcode"), "barcode_skipped_by_request"), (F.col("run_barcode") & F.col("barcode_failed"), "barcode_stage_failed"),
        (F.col("run_barcode") & ~F.col("barcode_failed") & ~detected, "barcode_not_detected"), (run & ~started, "ocr_skipped_request_budget_exhausted"), (started & F.col("ocr_cap_failed"), "ocr_raster_cap_failed"),
        (started & F.col("ocr_failed"), "ocr_stage_failed"), (no_ingredients, "ingredient_list_not_found"), (unreadable_panel, "nutrition_section_found_but_unreadable"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), w) for c, w in rules]))


def barcodes(kept: DataFrame, primaries: DataFrame, attempts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and codes (primary, results in order, engines_attempted) of each image, from fusion's tables keyed by image_id."""
    one = F.struct("position", "value", "format", "confidence", "confidence_source", "is_retail", "is_indian", "is_url", "engines")
    results = kept.groupBy("image_id").agg(F.array_sort(F.collect_list(one)).alias("results"))  # at most five an image
    engines = attempts.groupBy("image_id").agg(F.array_sort(F.collect_set(F.when(F.col("variants_tried") > 0, F.col("engine")))).alias("engines"))
    best = primaries.select("image_id", F.struct("value", "format", "confidence").alias("primary"))
    j = results.join(best, "image_id").join(engines, "image_id", "left")
    return j.select(F.col("image_id").alias(key), F.struct("primary", "results", F.col("engines").alias("engines_attempted")).alias("codes"))


def responses(requests: DataFrame, texts: DataFrame, codes: DataFrame) -> DataFrame:
    """doc_id, warnings and response (JSON) of every request.

    requests: doc_id and the columns of `warnings`; texts: doc_id, text; codes: doc_id, codes (see `barcodes`). Text
    that was not read is empty; codes of requests that ran no engines, or whose engines failed, are none.

    Texts are joined by a shuffle: the size of a table of short rows says nothing of texts made from it, which would be
    broadcast whole. Codes come before the reading, as what is read of a text is many times as wide. Then texts are
    dealt out by number, as adaptive execution would put some hundred thousand short ones into one task; without a
    key, as Spark drops a dealing by the join's key into as many parts as the join has.
    """
    tasks = max(requests.sparkSession.sparkContext.defaultParallelism, -(-requests.count() // TEXTS))
    asked = requests.join(texts.hint("merge"), "doc_id", "left").join(codes, "doc_id", "left").withColumn("text", F.when(text_was_read(), F.col("text")).otherwise(""))
    own = [c for c in requests.columns if c != "doc_id"]
    held = asked.select("doc_id", "text", F.struct(*own).alias("request"), "codes").repartition(tasks)
    read = L.with_panel(L.with_product(L.with_ingredients(L.repaired(held, ["request", "codes"])))).select("*", "request.*")
    looked = F.col("run_barcode") & ~F.col("barcode_failed")
    found = F.when(looked, F.col("codes"))
    detected = looked & F.col("codes").isNotNull()
    no_items = F.coalesce(F.size("items"), F.lit(0)) <= 0
    unreadable = F.col("panel").isNotNull() & (F.size("panel.values") == 0)
    read = read.withColumn("warnings", warnings(detected, no_items, unreadable))
    fields = F.map_from_entries(F.transform("product", lambda p: F.struct(p["field"], F.struct(*[p[c].alias(c) for c in ("value", "confidence", "confidence_source", "evidence")]))))
    read_text = text_was_read()
    document = F.struct(
        F.lit(True).alias("success"), F.lit("1").alias("schema_version"), F.struct("downscaled", "orientation_applied", "quality").alias("image"),
        F.struct(detected.alias("detected"), found["primary"].alias("primary"), F.coalesce(found["results"], F.slice(F.col("codes.results"), 1, 0)).alias("results"), found["engines_attempted"].alias("engines_attempted")).alias("barcode"),
        F.struct(read_text.alias("detected"), "normalized_text", F.when(~(F.col("ocr") & F.col("ocr_enabled")), "ocr_disabled").alias("failure_reason")).alias("ocr"),
        fields.alias("product"), F.struct((~no_items).alias("detected"), F.transform("items", lambda i: F.struct(*[i[c].alias(c) for c in ("path", "normalized", "code", "allergens")])).alias("items")).alias("ingredients"),
        F.struct((F.size("panel.values") > 0).alias("detected"), "panel.*").alias("nutrition"),
        F.struct(L.declared_allergens().alias("declared"), F.array_compact(F.array("statement")).alias("cross_contamination"), L.of_kind("allergens").isNotNull().alias("declared_in_section")).alias("allergens"),
        F.struct(L.label_codes().alias("ins_codes"), L.label_signals().alias("label_signals")).alias("signals"), "warnings",
    )
    return read.select("doc_id", "warnings", F.to_json(document).alias("response"))


_SHOWN = """barcode struct<primary struct<value string>, results array<struct<value string, format string, confidence int, confidence_source string, is_indian boolean, engines array<string>>>>, ocr struct<detected boolean>,
ingredients struct<items array<struct<normalized string>>>, warnings array<string>"""


def reports(answered: DataFrame) -> DataFrame:
    """doc_id and report: the lines that a console shows of a response (doc_id, response), of its codes, text, items and warnings."""
    d = answered.select("doc_id", F.from_json("response", _SHOWN).alias("d"))
    d = d.select("doc_id", "d.*").withColumn("best", F.get(F.filter("barcode.results", lambda r: r["value"] == F.col("barcode.primary.value")), 0))
    best = lambda c: F.col("best")[c]
    told = F.concat(best("value"), F.lit("  "), best("format"), F.lit("  confidence "), F.format_string("%.3f", best("confidence") / 1000.0), F.lit(" ("), best("confidence_source"), F.when(F.size(best("engines")) > 0, F.concat(F.lit(", engines: "), F.array_join(best("engines"), ", "))).otherwise(""), F.lit(")"))
    code = F.when(F.col("best").isNotNull(), told).when(F.array_contains("warnings", "barcode_skipped_by_request"), "skipped (--text-only)").otherwise("not detected")
    items = F.size("ingredients.items")
    lines = F.array_compact(F.array(
        F.concat(F.lit("barcode   "), code), F.when(best("is_indian"), "          Indian GS1 prefix (890...)"), F.concat(F.lit("ocr       "), F.when(F.col("ocr.detected"), "text detected").otherwise("no text detected")),
        F.concat(F.lit("ingredients "), F.when(items > 0, F.concat(items.cast("string"), F.lit(" found"))).otherwise("not found")), F.when(F.size("warnings") > 0, F.concat(F.lit("warnings  "), F.array_join("warnings", ", "))),
    ))
    return d.select("doc_id", F.array_join(lines, "\n").alias("report"))
