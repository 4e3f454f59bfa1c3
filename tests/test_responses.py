"""Whole analyses on a few requests whose results are known."""

import json

from pyspark.sql import functions as F

from veridex.functions import text as T
from veridex.operators import labels, responses

REQUEST = "doc_id int, downscaled boolean, orientation_applied boolean, quality string, run_barcode boolean, barcode_failed boolean, ocr boolean, ocr_enabled boolean, ocr_left_ms bigint, ocr_cap_failed boolean, ocr_failed boolean"
CODES = "doc_id int, codes struct<primary struct<value string, format string, confidence int>, results array<struct<position int, value string>>, engines_attempted array<string>>"
TEXT = "Ingredients: Sugar, Milk Solids (Soya Lecithin)\n\n\nNutrition Facts per 100 g\nEnergy 10 kcal\nServing size: 5 g"


def test_responses(spark):
    fine = (False, False, "good", True, False, True, True, 9000, False, False)
    asked = [(1, *fine), (2, True, True, "poor", False, False, True, False, 9000, False, False), (3, False, False, "fair", True, True, True, True, 999, True, True), (4, False, False, "good", True, False, True, True, 1000, True, False), (5, False, False, None, True, False, False, True, None, None, None), (6, *fine)]
    texts = [(1, TEXT), (2, TEXT), (3, TEXT), (4, "Nutrition Facts\nqqq zzz"), (5, TEXT)]
    codes = [(1, (("A", "EAN-13", 900), [(1, "A"), (2, "B")], ["ZBar"])), (3, (("C", "EAN-8", 800), [(1, "C")], ["ZBar"]))]
    done = responses.responses(spark.createDataFrame(asked, REQUEST), spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(codes, CODES))
    got = {r.doc_id: (r.warnings, json.loads(r.response)) for r in done.collect()}
    assert got[1][0] == [] and got[1][1]["barcode"]["primary"]["value"] == "A" and len(got[1][1]["barcode"]["results"]) == 2
    assert [i["normalized"] for i in got[1][1]["ingredients"]["items"]] == ["ingredients: sugar", "milk solids (soya lecithin)", "soya lecithin"]
    assert (got[1][1]["nutrition"]["basis"], got[1][1]["nutrition"]["serving_size"], got[1][1]["nutrition"]["undeciphered_lines"]) == ("per 100 g", "5 g", ["Serving size: 5 g"])
    assert got[2][0] == ["ocr_disabled_by_configuration", "image_downscaled_for_processing", "exif_orientation_applied", "low_image_quality", "barcode_skipped_by_request", "ingredient_list_not_found"]
    assert got[2][1]["ocr"] == {"detected": False, "normalized_text": "", "failure_reason": "ocr_disabled"} and got[2][1]["barcode"] == {"detected": False, "results": []} or got[2][1]["barcode"]["detected"] is False
    assert got[3][0] == ["barcode_stage_failed", "ocr_skipped_request_budget_exhausted", "ingredient_list_not_found"] and "primary" not in got[3][1]["barcode"]
    assert got[4][0] == ["barcode_not_detected", "ocr_raster_cap_failed", "ingredient_list_not_found", "nutrition_section_found_but_unreadable"]
    assert got[5][0] == ["barcode_not_detected", "ingredient_list_not_found"] and got[6][0] == ["barcode_not_detected", "ingredient_list_not_found"]


def test_panels(spark):
    t = ["Nutrition Facts\nProtein 1 g\nProtein 2 g\nFat nil\nwhat is this\nServes about 3 cup", "no panel", "Nutrition Facts:\nApprox. per 20 ml\nEnergy 5 kJ", None]
    p = {r.doc_id: r for r in labels.panels(spark.createDataFrame(list(enumerate(t)), "doc_id int, text string")).withColumn("n", F.size("values")).collect()}
    assert set(p) == {0, 2} and p[0].basis is None and p[0].serving_size == "3 cup" and p[0].n == 2 and p[0].undeciphered_lines == ["what is this", "Serves about 3 cup"]
    assert p[0]["values"][0].value == 1.0 and (p[2].basis, p[2].serving_size, p[2].n) == ("per 20 ml", "20 ml", 1) and p[2].confidence == 588


def test_texts_are_not_broadcast(spark):
    """Texts made from a small table may be large: they are joined by a shuffle."""
    asked = spark.createDataFrame([(1, False, False, "good", True, False, True, True, 9000, False, False)], REQUEST)
    done = responses.responses(asked, spark.createDataFrame([(1, TEXT)], "doc_id int, text string"), spark.createDataFrame([], CODES))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 1 and done.count() == 1


def test_texts_are_read_by_all_cores(spark):
    """Short texts are dealt over tasks by their number; by their bytes all of them would be read by one."""
    asked = spark.createDataFrame([(k, False, False, "good", True, False, True, True, 9000, False, False) for k in range(40)], REQUEST)
    done = responses.responses(asked, spark.createDataFrame([(k, TEXT) for k in range(40)], "doc_id int, text string"), spark.createDataFrame([], CODES))
    assert done.select(F.spark_partition_id()).distinct().count() > 1 and "REPARTITION_BY_NUM" in done._jdf.queryExecution().executedPlan().toString()


def test_repair_is_worked_out_once(spark):
    """The confidence of a log names the log once, and no list of matches stands inside the work on one of them."""
    t = spark.createDataFrame([("INS62I and SUG4R  \nP4LM 0IL",), ("plain",), (None,)], "text string")
    one = t.select(T.edit_confidence(T.corrections(F.col("text"))).alias("c"))
    assert one._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 3
    assert [r.c for r in one.collect()] == [0.898, 1.0, None]
    edits = t.limit(1).select(F.inline(T.corrections(F.col("text")))).collect()
    assert [(e.raw, e.corrected, e.start, e.end) for e in edits[:4]] == [("INS62I", "INS 621", 0, 6), ("SUG4R", "SUGAR", 12, 17), ("P4LM", "PALM", 20, 24), ("0IL", "OIL", 25, 28)]
