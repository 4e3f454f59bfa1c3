"""Connected components by minimum labels and pointer jumping, one written table per round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.llm.common import removed, written

#: A label that very many rows share is dealt over so many keys.
SALTS = 8


def dealt_join(rows: DataFrame, key: str, table: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """rows joined to table by `key`, which is unique in table and may be common in rows; `by` deals such rows out.

    Never a broadcast: the table's copies would make it larger than its size estimate says.
    """
    salt = "_salt_of_join"
    left = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right.hint("merge"), [key, salt], how).drop(salt)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node) for every node of edges (a, b: bigint). Links stay on the executors.

    Repeated edges and loops do no harm; a node that only has loops is not returned. No edges give no rows.
    """
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    now = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).select("node", F.least("node", "component").alias("component")), "labels")
    while True:
        near = dealt_join(both, "b", now.withColumnRenamed("node", "b"), F.col("a")).groupBy("a").agg(F.min("component").alias("least"))
        lower = now.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        labels = lower.select(F.col("component").alias("node")).distinct()
        above = lower.select("node", F.col("component").alias("above")).join(labels, "node").withColumnRenamed("node", "component")
        new = written(dealt_join(lower, "component", above, F.col("node")).select("node", "old", F.col("above").alias("component")), "labels")
        changed = new.filter("old <> component").limit(1).count()
        removed(spark, now)
        now = new
        if not changed:
            removed(spark, both)
            return now.select("node", "component")
