"""Service counters as observed metrics: counted while another query runs over the rows, in a batch or a stream.

Rows are analyses: failed, barcode, ocr, ingredients and cached (booleans), latency_ms. A null barcode, ocr or cached
means that the step was not tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from veridex.functions.rates import fixed

COUNTERS = {
    "requests_total": "true", "requests_failed_total": "failed", "analysis_barcode_detected_total": "barcode", "analysis_barcode_missed_total": "not barcode",
    "analysis_ocr_detected_total": "ocr", "analysis_ocr_missed_total": "not ocr", "analysis_ingredients_found_total": "ingredients", "cache_hits_total": "cached", "cache_misses_total": "not cached",
}
#: rate: counted, of which; the second are added up.
RATES = {
    "barcode_detection_rate": ("analysis_barcode_detected_total", ["analysis_barcode_detected_total", "analysis_barcode_missed_total"]),
    "ocr_success_rate": ("analysis_ocr_detected_total", ["analysis_ocr_detected_total", "analysis_ocr_missed_total"]),
    "ingredient_extraction_rate": ("analysis_ingredients_found_total", ["analysis_ocr_detected_total", "analysis_ocr_missed_total"]),
    "cache_hit_rate": ("cache_hits_total", ["cache_hits_total", "cache_misses_total"]),
    "error_rate": ("requests_failed_total", ["requests_total"]),
}


def counters() -> list[Column]:
    return [F.count_if(F.expr(c)).alias(k) for k, c in COUNTERS.items()] + [F.coalesce(F.sum("latency_ms"), F.lit(0)).cast("bigint").alias("latency_total_ms"), F.max("latency_ms").cast("bigint").alias("latency_max_ms")]


def observed(analyses: DataFrame, name: str = "service") -> tuple[DataFrame, Observation]:
    """analyses, and the counters that are there once a query over them has run; no second pass."""
    seen = Observation(name)
    return analyses.observe(seen, *counters()), seen


class Totals(StreamingQueryListener):
    """Adds up the counters that a stream's batches observe under a name; of maxima the greatest."""

    def __init__(self, name: str = "service"):
        self.name, self.counts, self.batches = name, {}, set()

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        row, batch = event.progress.observedMetrics.get(self.name), (event.progress.runId, event.progress.batchId)
        if row is None or batch in self.batches:
            return
        self.batches.add(batch)
        for k, v in row.asDict().items():
            if v is not None:
                self.counts[k] = max(self.counts.get(k, v), v) if "_max_" in k else self.counts.get(k, 0) + v


def counts_row(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """Counters as one row; what was never counted is 0, a maximum of nothing null."""
    names = [*COUNTERS, "latency_total_ms", "latency_max_ms"]
    return spark.createDataFrame([tuple(counts.get(n, None if "_max_" in n else 0) for n in names)], ", ".join(f"{n} bigint" for n in names))


def derived_rates(counts: DataFrame) -> DataFrame:
    """The service's rates from its counters, to four digits; 0 where nothing was counted."""
    one = lambda n, of: F.coalesce(fixed(F.try_divide(F.col(n).cast("double"), sum((F.col(c) for c in of[1:]), F.col(of[0]))), 4), F.lit(0.0))
    return counts.select(*[one(n, of).alias(k) for k, (n, of) in RATES.items()])
