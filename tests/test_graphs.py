"""Range joins against the standard library's networks, trees against plain walks."""

import ipaddress
import random
import re

from pyspark.sql import functions as F

from veridex.operators import ranges, trees


def plain_ip(text):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def number(ip):
    return (0xFFFF << 32) + int(ip) if ip.version == 4 else int(ip)


def holds(cidr, text):
    ip, net = plain_ip(text), ipaddress.ip_network(cidr, strict=False)
    bits = net.prefixlen + (96 if net.version == 4 else 0)
    return ip is not None and number(ip) >> (128 - bits) == number(net.network_address) >> (128 - bits)


def test_ranges_against_networks(spark):
    rnd = random.Random(5)
    four = lambda: ".".join(str(rnd.choice([10, 10, 192, 168, rnd.randrange(256)])) for _ in range(4))
    six = lambda: str(ipaddress.IPv6Address(0x20010DB8 << 96 | rnd.getrandbits(rnd.choice([8, 40, 90]))))
    cidrs = [f"{four()}/{rnd.choice([0, 1, 8, 9, 15, 16, 17, 24, 31, 32])}" for _ in range(150)] + [f"{six()}/{rnd.choice([0, 3, 16, 17, 32, 63, 64, 65, 100, 128])}" for _ in range(150)]
    rows = [four() for _ in range(300)] + [six() for _ in range(300)] + ["::ffff:10.0.0.1", "::1", "::", "FE80::1", "300.1.1.1", "1.2.3", "x", "", None, "1:2:3"] + ["10.10.10.10"] * 400
    listed = [*enumerate(cidrs), (900, "bad/3"), (901, "1.2.3.4"), (902, "1.2.3.4/33"), (903, None), (904, "::/129"), (905, cidrs[0])]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, ip string").withColumns({"range": F.lit("old"), "bits": F.lit(1), "key": F.lit("k")})
    known = spark.createDataFrame(listed, "id int, cidr string").select("cidr", "id")
    length = lambda c: int(c.rpartition("/")[2]) + (0 if ":" in c else 96)
    for order in (None, "id"):
        got = {r.id: r.range and r.range.id for r in ranges.range_join(df, "ip", known, order).collect()}
        for i, ip in enumerate(rows):
            fit = [(k, c) for k, c in listed if k < 900 and ip and holds(c, ip)]
            best = min(fit, key=lambda x: x[0] if order else (-length(x[1]), x[1], x[0]), default=(None,))
            want = {k for k, c in fit if not order and length(c) == length(best[1])} if fit and not order else {best[0]}
            assert got[i] in want, (ip, got[i], best)
    assert ranges.range_join(df, "ip", known.limit(0)).filter("range is not null").count() == 0
    assert ranges.range_join(df.limit(0), "ip", known).count() == 0


def test_many_ranges_without_nested_loops(spark):
    """100,000 ranges: equality joins only, whatever of them is broadcast."""
    known = spark.range(100_000).select(F.concat_ws(".", (F.col("id") % 223 + 1).cast("string"), (F.col("id") % 251).cast("string"), (F.col("id") % 241).cast("string"), F.lit("0")).alias("ip"), "id")
    known = known.select(F.concat("ip", F.lit("/"), (8 + F.col("id") % 17).cast("string")).alias("cidr"), "id")
    rows = spark.range(20_000).select(F.concat_ws(".", (F.col("id") % 256).cast("string"), (F.col("id") % 250).cast("string"), (F.col("id") % 240).cast("string"), F.lit("9")).alias("ip"))
    got = ranges.range_join(rows, "ip", known)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.count() == 20_000 and got.filter("range is null").count() < 20_000


def test_looks_are_not_broadcast(spark):
    """An address looks once for each length: what is made of a small table is joined by a shuffle."""
    rows, known = spark.createDataFrame([("10.1.2.3",)], "ip string"), spark.createDataFrame([("10.1.2.0/24", 1), ("10.0.0.0/9", 2)], "cidr string, id int")
    for order, best in ((None, 1), ("id", 1)):
        got = ranges.range_join(rows, "ip", known, order)
        assert got._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 2
        assert [r.range.id for r in got.collect()] == [best]


def test_ranges_are_read_once(spark):
    """Both sides of the join, of short and of long ranges, use the same shuffled ranges."""
    rows = spark.createDataFrame([("10.1.2.3",), ("2001:db8::1",), ("256.1.1.1",)], "ip string")
    known = spark.createDataFrame([("10.1.2.0/24", 1), ("10.0.0.0/9", 2), ("2001:db8::/32", 3), ("10.1.2.3/33", 4)], "cidr string, id int")
    got = ranges.range_join(rows, "ip", known)
    assert {r.ip: r.range and r.range.id for r in got.collect()} == {"10.1.2.3": 1, "2001:db8::1": 3, "256.1.1.1": None}
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert any("ReusedExchange" in line and "min" in line for line in plan.splitlines())


def test_trees(spark):
    rnd = random.Random(1)
    parent = {i: None if i % 500 == 0 else rnd.randrange(max(0, i - 4), i) for i in range(1000)}  # deep: some 400 levels
    rows = [*parent.items(), (5000, 5001), (5001, 5000), (6000, 7777), (None, 3)]
    df = spark.createDataFrame(rows, "id bigint, parent bigint").withColumns({"path": F.lit("x"), "depth": F.lit(1), "w": F.lit(2)})
    path = {}
    for i, p in parent.items():
        path[i] = [*(path[p] if p is not None else []), i]
    got = {r.id: r for r in trees.paths(df).collect()}
    assert {i: (r.parent, r.root, r.depth, r.path) for i, r in got.items()} == {i: (parent[i], p[0], len(p) - 1, p) for i, p in path.items()}
    below = {i: 0 for i in parent}
    for i in parent:
        for a in path[i][:-1]:
            below[a] += 1
    sums = {r.id: (r.depth, r.below, r.children, r.weight) for r in trees.rolled_up(df, {"weight": "w"}).collect()}
    assert sums == {i: (len(path[i]) - 1, below[i], sum(p == i for p in parent.values()), 2 * below[i] + 2) for i in parent}
    twice = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (4, 3), (2, 4)], "id int, parent int")  # two parents, and a way back
    assert sorted(tuple(r.path) for r in trees.paths(twice).collect()) == [(1,), (1, 2), (1, 2, 4), (1, 3), (1, 3, 4), (1, 3, 4, 2)]
    assert trees.paths(df.limit(0)).count() == 0


def test_paths_are_dealt_out_before_they_are_climbed(spark, monkeypatch):
    """The tasks that hold all pairs of nodes and ancestors grow in number with the nodes; pairs aren't shuffled to be told apart."""
    monkeypatch.setattr(trees, "NODES", 4)
    nodes = spark.createDataFrame([(k, (k - 1) // 2 if k else None, 1) for k in range(31)] + [(30, 0, 1)], "id bigint, parent bigint, v bigint")
    got = trees.rolled_up(nodes, {"v": "v"})
    rows = {r.id: (r.depth, r.below, r.children, r.v) for r in got.collect()}
    assert len(rows) == 31 and rows[0] == (0, 31, 3, 34) and rows[14] == (3, 2, 2, 4) and rows[30] == (1, 0, 0, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("8), REPARTITION_BY_NUM") >= 2 and "hashpartitioning(ancestor#" in plan and not re.search(r"hashpartitioning\(ancestor#\w+, depth#", plan)
