"""Every query runs; those with SQL agree with DuckDB, values and all."""

import math
import os

import pandas as pd
import pytest

from veridex.plans import catalog

from .conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item") and not isinstance(v, pd.Timestamp):
        return plain(v.item()) if getattr(v, "ndim", 0) == 0 else str([plain(x) for x in v])
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    return v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, ([plain(v) for v in r] for r in df[cols].itertuples(index=False))))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(duck.sql(sql).df())
    else:
        assert len(got.columns)
