"""Queries that join addresses with ranges, and that climb trees, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridex.operators import ranges, trees
from veridex.plans.code_queries import _IP
from veridex.plans.registry import query
from veridex.sources.views import spread

#: A range for each order: its length goes from 8 to 32.
_CIDR = "CAST(o_orderkey * 37 % 256 AS STRING) || '.' || CAST(o_orderkey * 11 % 256 AS STRING) || '.' || CAST(o_orderkey % 7 AS STRING) || '.' || CAST(o_orderkey % 200 AS STRING) || '/' || CAST(8 + o_orderkey % 25 AS STRING)"
_NUMBERS = f"""c AS (SELECT c_custkey, {_IP} AS ip, CASE WHEN c_custkey * 11 % 260 < 256 THEN (c_custkey * 37 % 256) * 16777216 + (c_custkey * 11 % 260) * 65536 + (c_custkey % 7) * 256 + c_custkey % 200 END AS n FROM customer),
r AS (SELECT o_orderkey AS id, {_CIDR} AS cidr, 8 + o_orderkey % 25 AS bits, (o_orderkey * 37 % 256) * 16777216 + (o_orderkey * 11 % 256) * 65536 + (o_orderkey % 7) * 256 + o_orderkey % 200 AS base FROM orders),
m AS (SELECT c_custkey, r.* FROM c JOIN r ON c.n >> (32 - bits) = base >> (32 - bits))"""


#: Rows of a task that reads addresses or ranges: a file of few bytes may hold very many.
ROWS = 200_000


def _table(spark, sf_dir, name: str):
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), ROWS)


def _addresses(spark, sf_dir):
    return _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_IP} AS ip")


def _ranges(spark, sf_dir):
    return _table(spark, sf_dir, "orders").selectExpr(f"{_CIDR} AS cidr", "o_orderkey AS id")


@query(f"WITH {_NUMBERS}, b AS (SELECT c_custkey, arg_min(cidr, (-bits, cidr, id)) AS cidr, arg_min(id, (-bits, cidr, id)) AS range_id FROM m GROUP BY 1) SELECT c.c_custkey, c.ip, b.cidr, b.range_id FROM c LEFT JOIN b USING (c_custkey)")
def ip_longest_range(spark, sf_dir):
    """The longest of as many ranges as there are orders that holds a customer's address."""
    got = ranges.range_join(_addresses(spark, sf_dir), "ip", _ranges(spark, sf_dir))
    return got.select("c_custkey", "ip", "range.cidr", F.col("range.id").alias("range_id"))


@query(f"WITH {_NUMBERS}, b AS (SELECT c_custkey, arg_min(cidr, id) AS cidr, min(id) AS range_id FROM m GROUP BY 1) SELECT c.c_custkey, c.ip, b.cidr, b.range_id FROM c LEFT JOIN b USING (c_custkey)")
def ip_first_range(spark, sf_dir):
    """The first range in the order of the list, whatever its length."""
    got = ranges.range_join(_addresses(spark, sf_dir), "ip", _ranges(spark, sf_dir), order="id")
    return got.select("c_custkey", "ip", "range.cidr", F.col("range.id").alias("range_id"))


def _hex(c: str) -> str:
    return f"lower(hex(CAST({c} AS BIGINT)))"


_IP6 = f"'2001:db8:' || {_hex('c_custkey % 9')} || ':' || {_hex('c_custkey * 31 % 65536')} || '::' || {_hex('c_custkey % 77')}"
_CIDR6 = f"'2001:DB8:' || {_hex('p_partkey % 9')} || ':' || {_hex('p_partkey * 31 % 65536')} || '::/' || CAST(30 + p_partkey % 35 AS STRING)"


@query(
    f"""WITH c AS (SELECT c_custkey, {_IP6} AS ip, (c_custkey % 9) * 65536 + c_custkey * 31 % 65536 AS n FROM customer),
r AS (SELECT p_partkey AS id, {_CIDR6} AS cidr, 30 + p_partkey % 35 AS bits, (p_partkey % 9) * 65536 + p_partkey * 31 % 65536 AS base FROM part),
b AS (SELECT c_custkey, arg_min(id, (-bits, cidr, id)) AS range_id, max(bits) AS bits FROM c JOIN r ON bits <= 32 OR c.n >> (64 - bits) = base >> (64 - bits) GROUP BY 1)
SELECT c.c_custkey, c.ip, b.range_id, CAST(b.bits AS INT) AS bits FROM c LEFT JOIN b USING (c_custkey)"""
)
def ipv6_longest_range(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_IP6} AS ip")
    r = _table(spark, sf_dir, "part").selectExpr(f"{_CIDR6} AS cidr", "p_partkey AS id", "CAST(30 + p_partkey % 35 AS INT) AS bits")
    return ranges.range_join(c, "ip", r).select("c_custkey", "ip", F.col("range.id").alias("range_id"), "range.bits")


_NODES = "SELECT c_custkey AS id, CASE WHEN c_custkey > 2 THEN (c_custkey - 1) // 2 END AS parent, CAST(floor(c_acctbal) AS BIGINT) AS balance FROM customer"
_TREE = f"n AS ({_NODES}), t AS (SELECT id, parent, id AS root, 0 AS depth, [id] AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, n.parent, t.root, t.depth + 1, list_append(t.path, n.id) FROM n JOIN t ON n.parent = t.id)"


def _nodes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS id", "CASE WHEN c_custkey > 2 THEN (c_custkey - 1) div 2 END AS parent", "CAST(floor(c_acctbal) AS BIGINT) AS balance")


@query(f"WITH RECURSIVE {_TREE} SELECT id, parent, root, CAST(depth AS INT) AS depth, array_to_string(path, '/') AS path FROM t")
def tree_paths(spark, sf_dir):
    """Every customer below the one of half its key: trees of some ten levels."""
    return trees.paths(_nodes(spark, sf_dir)).select("id", "parent", "root", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query(f"WITH RECURSIVE {_TREE}, d AS (SELECT unnest(path) AS id, balance, t.depth, t.id AS below FROM t JOIN n USING (id)) SELECT d.id, CAST(any_value(t.depth) AS INT) AS depth, count(*) - 1 AS below, count(*) FILTER (d.depth = t.depth + 1) AS children, CAST(sum(balance) AS BIGINT) AS balance FROM d JOIN t USING (id) GROUP BY d.id")
def tree_rollup(spark, sf_dir):
    return trees.rolled_up(_nodes(spark, sf_dir), {"balance": "balance"})
