"""Trees given by (id, parent) rows, of any depth, by recursive queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_LEVELS = 1000
#: Nodes of a task that climbs from them to all their ancestors.
NODES = 20_000


def paths(nodes: DataFrame, id: str = "id", parent: str = "parent", most_levels: int = MOST_LEVELS) -> DataFrame:
    """id, parent, root, depth (0 for roots) and path (ids from the root down) of every node that hangs on a root.

    A root has a null parent. An id that is there more than once has a row for each of its paths; a path that comes
    back to itself ends before. Nodes on a cycle or below a missing parent hang on no root and don't come out. Trees
    deeper than `most_levels` are an error. For the session, the limit of rows of recursive queries is lifted where
    it has its default, which is meant for runaway queries.
    """
    spark = nodes.sparkSession
    if spark.conf.get("spark.sql.cteRecursionRowLimit", "1000000") == "1000000":
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    n = nodes.select(F.col(f"`{id}`").alias("id"), F.col(f"`{parent}`").alias("parent"))
    return spark.sql(
        f"""WITH RECURSIVE t(id, parent, root, depth, path) MAX RECURSION LEVEL {int(most_levels)} AS (
          SELECT id, parent, id, 0, array(id) FROM {{n}} WHERE parent IS NULL AND id IS NOT NULL
          UNION ALL
          SELECT n.id, n.parent, t.root, t.depth + 1, array_append(t.path, n.id) FROM {{n}} n JOIN t ON n.parent = t.id WHERE NOT array_contains(t.path, n.id)
        ) SELECT * FROM t""",
        n=n,
    )


def pairs_below(found: DataFrame) -> DataFrame:
    """Of paths: (ancestor, depth of the ancestor, id, distance), each node being its own ancestor at distance 0. Rows number nodes times depth."""
    up = found.select("id", F.col("depth").alias("own"), F.posexplode("path").alias("depth", "ancestor"))
    return up.select("ancestor", "depth", "id", (F.col("own") - F.col("depth")).alias("distance"))


def rolled_up(nodes: DataFrame, values: dict[str, str], id: str = "id", parent: str = "parent") -> DataFrame:
    """For each node: depth, children, below (nodes under it), and each of `values` (name: column) summed over it and all below.

    Sums are pre-aggregated before the shuffle, so that a root that has everything below it costs no more than others.
    Paths are dealt out by id before they are climbed: the deepest levels have most nodes in few tasks, and all pairs of
    an id then stand together for what follows.
    """
    tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // NODES))
    own = nodes.repartition(tasks, F.col(f"`{id}`")).groupBy(F.col(f"`{id}`").alias("id")).agg(*[F.sum(F.col(f"`{c}`")).alias(k) for k, c in values.items()])
    under = pairs_below(paths(nodes, id, parent).repartition(tasks, "id")).distinct().join(own, "id")
    count = lambda c: F.count_if(F.expr(c))
    return under.groupBy(F.col("ancestor").alias("id")).agg(F.min("depth").alias("depth"), count("distance > 0").alias("below"), count("distance = 1").alias("children"), *[F.sum(k).alias(k) for k in values])
