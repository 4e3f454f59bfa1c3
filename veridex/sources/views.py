"""Derived views over the star-schema tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "bench_records": (
        "events",
        """SELECT event_id AS id, 'session-' || CAST(user_id % 20 AS STRING) AS session_id, event_type AS engine, event_id AS frame_number, ts,
  CASE event_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'live' ELSE 'angle' END AS test_type,
  CASE WHEN event_id % 10 < 6 THEN 'correct' WHEN event_id % 10 < 8 THEN 'incorrect' ELSE 'miss' END AS classification,
  CASE WHEN event_id % 10 < 8 THEN CAST(floor(value) AS BIGINT) END AS detection_time_ms,
  CASE WHEN event_id % 3 = 2 THEN CAST((user_id % 7) * 15 AS INT) END AS angle,
  event_id % 10 < 6 AS success, user_id AS image_id,
  CASE event_id % 4 WHEN 0 THEN 'original' WHEN 1 THEN 'grayscale' WHEN 2 THEN 'clahe' ELSE 'sharpen' END AS variant,
  CASE WHEN event_id % 10 < 8 THEN '890' || CAST((event_id % 7) * (user_id % 3) AS STRING) END AS barcode_value
FROM {events}""",
    ),
    "observations": (
        "lineitem",
        """SELECT image_id, ord, body || CAST(CASE WHEN l_linenumber = 7 THEN (chk + 1) % 10 ELSE chk END AS STRING) || CASE WHEN ord % 11 = 0 THEN ' ' ELSE '' END AS value,
  CASE WHEN ord % 13 = 0 THEN 'UPC-A' WHEN ord % 17 = 0 THEN 'Code 128' ELSE 'EAN-13' END AS format,
  CASE l_linenumber % 3 WHEN 0 THEN 'ZBar' WHEN 1 THEN 'ZXing-C++' ELSE 'ZXing' END AS engine, l_returnflag || l_linestatus AS variant, decode_ms
FROM (SELECT *, CAST((10 - (1 * (CAST(substr(body, 1, 1) AS INT) + CAST(substr(body, 3, 1) AS INT) + CAST(substr(body, 5, 1) AS INT) + CAST(substr(body, 7, 1) AS INT) + CAST(substr(body, 9, 1) AS INT) + CAST(substr(body, 11, 1) AS INT))
    + 3 * (CAST(substr(body, 2, 1) AS INT) + CAST(substr(body, 4, 1) AS INT) + CAST(substr(body, 6, 1) AS INT) + CAST(substr(body, 8, 1) AS INT) + CAST(substr(body, 10, 1) AS INT) + CAST(substr(body, 12, 1) AS INT))) % 10) % 10 AS INT) AS chk
  FROM (SELECT l_orderkey % 3000 AS image_id, l_orderkey * 8 + l_linenumber AS ord, '8901262' || lpad(CAST((l_orderkey % 3000) * 8 + l_partkey % 8 AS STRING), 5, '0') AS body,
    l_linenumber, l_returnflag, l_linestatus, CAST(floor(l_quantity) AS INT) AS decode_ms FROM {lineitem}))""",
    ),
    "label_text": (
        "part",
        """SELECT p_partkey AS doc_id, p_brand || ' ' || p_type || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN 'NON-VEG' ELSE 'VEG' END || chr(10)
  || 'Ingredients: SUG4R, Wheat Flour, INS ' || CAST(300 + p_partkey % 40 AS STRING) || ', P4LM 0IL and Milk Solids (Soya Lecithin, INS 471), INS62I' || chr(10)
  || CASE WHEN p_partkey % 4 = 0 THEN 'May contain: nuts and sesame' || chr(10) ELSE '' END
  || 'Nutrition Information (per 100 g)' || chr(10) || 'Energy ' || CAST(50 + p_partkey % 400 AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN ' kcal' ELSE ' kJ' END || chr(10)
  || 'Protein ' || CAST(p_partkey % 30 AS STRING) || '.5 g' || chr(10) || 'Sodium ' || CAST(p_partkey % 900 AS STRING) || ' mg' || chr(10)
  || CASE WHEN p_partkey % 5 = 0 THEN 'Zzz qqq 1.2' ELSE 'Trans fat trace' END || chr(10) || 'Protein 9 g' || chr(10) || 'Net Qty: ' || CASE WHEN p_partkey % 6 = 0 THEN '4 x ' || CAST(p_size AS STRING) || ' g' ELSE CAST(p_size * 10 AS STRING) || ' g  ' END || chr(10)
  || 'MRP Rs. ' || CAST(10 + p_partkey % 200 AS STRING) || '.50' || chr(10) || 'FSSAI Lic. No. ' || CAST(10012051000000 + p_partkey AS STRING) || chr(10)
  || 'Best Before: ' || CAST(1 + p_partkey % 24 AS STRING) || ' months' || chr(10) || 'Made in India' AS text
FROM {part}""",
    ),
    "requests": (
        "part",
        """SELECT p_partkey AS doc_id, p_partkey % 2 = 0 AS downscaled, p_partkey % 5 = 0 AS orientation_applied, CASE p_partkey % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'fair' ELSE 'poor' END AS quality, p_partkey % 7 <> 0 AS run_barcode, p_partkey % 11 = 0 AS barcode_failed,
  p_partkey % 13 <> 0 AS ocr, p_partkey % 17 <> 0 AS ocr_enabled, CAST(p_partkey % 19 * 400 AS BIGINT) AS ocr_left_ms, p_partkey % 23 = 0 AS ocr_cap_failed, p_partkey % 29 = 0 AS ocr_failed FROM {part}""",
    ),
    "rich_labels": (
        "part",
        """SELECT p_partkey AS doc_id, 'Sunrise Masala Chips' || chr(10) || 'Brand: Sunrise' || chr(10) || CASE p_partkey % 3 WHEN 0 THEN 'Flavour: Chilli' WHEN 1 THEN 'Variant: Lime' ELSE 'Crisp ﬁne chips – a “snack”' END || chr(10)
  || CASE WHEN p_partkey % 4 = 1 THEN '' ELSE 'Ingredients: Potato, Refined Oil (Palm Oil, Soybean Oil (Antioxidant (INS 319, INS 320))), Spices (Chilli, Salt' || CASE WHEN p_partkey % 4 = 2 THEN '' ELSE ')' END || chr(10) || chr(10) || chr(10) || 'Ingredients continued: Milk Powder' || chr(10) || chr(10) || chr(10) END
  || 'Nutrition Facts per 30 g' || chr(10) || CASE WHEN p_partkey % 6 = 1 THEN 'qqq zzz' ELSE 'Energy ' || CAST(100 + p_partkey % 50 AS STRING) || ' kcal' || chr(10) || 'Protein 6.5 g' || chr(10) || 'Fat ' || CAST(p_partkey % 9 AS STRING) || ' g' || chr(10) || 'Protein 2 g' || chr(10) || 'Mystery 5' END || chr(10)
  || CASE WHEN p_partkey % 2 = 0 THEN 'Serves about 4 piece' ELSE 'Vitamin trace' END || chr(10) || chr(10) || chr(10) || 'Allergen information: milk' || chr(10) || 'Contains: gluten' || chr(10) || 'Storage: keep in a cool place' || chr(10) || chr(10) || chr(10) || 'How to use: open and eat' || chr(10) || chr(10) || chr(10)
  || 'Manufactured by: Golden Foods, Plot ' || CAST(p_partkey % 7 AS STRING) || chr(10) || 'FSSAI Lic. No. ' || CAST(10012051000000 + p_partkey AS STRING) || chr(10) || 'MRP Rs. 55.00' || chr(10) || 'Net Qty: 200 g' || chr(10) || 'Best Before: 6 months' || chr(10) || 'No added preservatives' AS text
FROM {part}""",
    ),
}


#: Views whose rows take much work each, and how many rows make a task of it.
HEAVY = {"observations": 1_000_000, "label_text": 5_000, "rich_labels": 5_000}


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal rows out if the files make fewer tasks than there are cores, or than their rows need at `rows` a task; by keys if there are any."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))  # Parquet counts from its footers
    if keys:
        return df.repartition(tasks, *keys)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = VIEWS[name]
    base = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql, **{table: spread(base, HEAVY[name]) if name in HEAVY else base})


def with_views(sql: str, *names: str) -> str:
    """The statement with the views it reads as common table expressions."""
    parts = [f"{n} AS ({VIEWS[n][1].replace('{' + VIEWS[n][0] + '}', VIEWS[n][0])})" for n in names]
    body = sql.strip()
    return f"WITH {', '.join(parts)}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {', '.join(parts)} {body}"
