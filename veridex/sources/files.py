"""Readers and writers of record files and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SCHEMA = """id string, session_id string, engine string, barcode_value string, expected_value string, format string, timestamp bigint,
frame_number bigint, detection_time_ms bigint, camera string, resolution string, test_type string, test_condition string, angle int,
distance_cm double, classification string, success boolean"""
#: First bytes (hex) of image files: pattern of the first 12 bytes, type.
SIGNATURES = [
    ("FFD8FF%", "jpeg"), ("89504E470D0A1A0A%", "png"), ("52494646________57454250%", "webp"), ("47494638%", "gif"), ("424D%", "bmp"),
    ("________6674797061766966%", "avif"), ("________6674797061766973%", "avif"), ("________6674797068656963%", "heif"), ("________6674797068656978%", "heif"),
    ("________667479706D696631%", "heif"), ("49492A00%", "tiff"), ("4D4D002A%", "tiff"),
]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Import a JSON array of records: rows without engine or timestamp go, the others get new ids."""
    rows = spark.read.schema(RECORD_SCHEMA).option("multiLine", True).json(path)
    return rows.filter("engine is not null and timestamp is not null").withColumn("id", F.expr("uuid()"))


def csv_line(columns: list[str]) -> Column:
    """One CSV line: quotes only where needed, doubled inside, nulls empty."""

    def cell(c: str) -> Column:
        s = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.regexp_replace(s, '"', '""'), F.lit('"'))).otherwise(s)

    parts = [cell(columns[0])]
    for c in columns[1:]:
        parts += [F.lit(","), cell(c)]
    return F.concat(*parts)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, pretty: bool = False) -> None:
    if pretty:
        df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_records(df: DataFrame, path: str) -> None:
    """The record store: partitioned by kind of test, so that live and image views prune."""
    df.write.mode("append").partitionBy("test_type").parquet(path)


def truncate(spark: SparkSession, path: str) -> None:
    old = spark.read.parquet(path)
    spark.createDataFrame([], old.schema).write.mode("overwrite").parquet(path)


def image_type(content: str) -> Column:
    """The type that an image's first bytes tell; null if none."""
    head = F.hex(F.substring(F.col(content), 1, 12))
    out = None
    for pattern, name in SIGNATURES:
        out = F.when(head.like(pattern), name) if out is None else out.when(head.like(pattern), name)
    return out


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Files that start like an image, with their type."""
    return spark.read.format("binaryFile").load(path).withColumn("image_type", image_type("content")).filter("image_type is not null")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A ground-truth manifest: one row per fixture with file, kind, note and what is expected of it (null if nothing)."""
    expect = "struct<barcode string, format string, also_expects array<string>, net_quantity string, mrp struct<amount double, currency string>, fssai_license string, veg_marker string, ins_codes array<string>, allergen_candidates array<string>, nutrition_nutrients array<string>, ocr_text string>"
    m = spark.read.schema(f"fixtures array<struct<file string, kind string, expect {expect}, note string>>").option("multiLine", True).json(path)
    return m.select(F.inline("fixtures"))


def with_expectations(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """found (file, ...) with what the manifest expects of each file; the manifest is looked up by file."""
    return found.join(manifest.select("file", "expect"), "file", "left")
