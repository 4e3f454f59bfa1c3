"""All queries of the library outside llm."""

from __future__ import annotations

from veridex.plans import analysis_queries, code_queries, graph_queries, label_queries, ocr_queries, raster_queries, record_queries, service_queries, stream_queries  # noqa: F401  registers its queries
from veridex.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
