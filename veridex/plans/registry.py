"""The catalogue of queries: a name, a DataFrame function of (spark, sf_dir), and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veridex.sources.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _counts_as_bigint(sql: str) -> str:
    """DuckDB sums counts to HUGEINT; say BIGINT, as Spark has it."""
    out, at = [], 0
    while (k := sql.find("count_if(", at)) >= 0:
        depth, end = 0, k + 8
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        out.append(f"{sql[at:k]}CAST({sql[k:end]} AS BIGINT)")
        at = end
    return "".join(out) + sql[at:]


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            sql_ = _counts_as_bigint(sql).replace("100.0", "100e0")
            ORACLES[f.__name__] = with_views(sql_, *views) if views else sql_
        return f

    return add
