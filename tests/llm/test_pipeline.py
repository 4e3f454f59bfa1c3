import os

import pytest

import corpus_pipeline
from veridex.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == columns
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        all_ = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= all_ and len(kept) > 0.6 * len(all_)
        docs = docs.filter(docs.doc_id.isin(sorted(kept)))
    packed = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_oracles(spark):
    import duckdb

    from tests.test_queries import TABLES, rows

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        assert rows(queries.queries()[name](spark, DATA).toPandas()) == rows(con.sql(sql).df()), name


def test_awkward_rows(spark):
    """Null and repeated ids, null, empty and equal texts go through every stage; clean rows stay once each, whole."""
    from pyspark.sql import functions as F

    rows = [(None, "first text without an id, long enough to be told from the others by its words", "a"), (None, "second text without an id and with quite other words than those of the first one", "b"), (7, "one text under a repeated id that has nothing in common with the rest", "c"), (7, "another text under the same repeated id, about rivers, lamps and glass", "d"), (8, None, "e"), (9, "", "f"), (7, "one text under a repeated id that has nothing in common with the rest", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        want = {"a", "b", "c", "d", "e"} if name != "toxicity" else {"a", "b", "c", "d", "e", "f"}
        got = sorted(r.lang for r in docs.collect())
        assert set(got) == want and (name == "toxicity" or len(got) == len(want)), name
    packed = corpus_pipeline.packing(spark, docs, DATA).collect()
    assert sum(r.length for r in packed) == sum(n for n in {(r.doc_id, r.doc_tokens, r.ids_crc32): r.length for r in packed}.values())
