"""Samples of bounded size that the data alone decide, so that they can be merged and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 512


def draw(*id: str) -> Column:
    """A hash of a row's id that is as good as a random number."""
    return F.md5(F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in id]).cast("binary"))


def bottom_k(rows: DataFrame, keys: list[str], id: str, k: int = SAMPLE) -> DataFrame:
    """Of each group the k rows of least hash of their id, ties by id: a uniform sample without replacement.

    The samples of two tables and bottom_k of their union is the sample of the whole, in any order and split. Each
    partition keeps k rows of a group before the shuffle, so a group of any size costs a task k rows a partition.
    """
    w = Window.partitionBy(*[f"`{c}`" for c in keys]).orderBy("_draw", f"`{id}`")
    return rows.withColumn("_draw", draw(id)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_draw", "_n")


def merged(*samples: DataFrame, keys: list[str], id: str, k: int = SAMPLE) -> DataFrame:
    """The sample of all that the given samples were drawn from; their rows must be of different ids."""
    out = samples[0]
    for s in samples[1:]:
        out = out.unionByName(s)
    return bottom_k(out, keys, id, k)


def sampled_stats(sample: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """n and percentiles by floor rank of a sample's values; state is bounded by the sample."""
    from veridex.functions.rates import floor_rank

    g = sample.groupBy(*keys).agg(F.count(value).alias("n"), F.collect_list(value).alias("v"))
    return g.select(*keys, "n", *[floor_rank(F.col("v"), p).alias(f"p{p}") for p in percents])


def sample_sink(path: str, keys: list[str], id: str, k: int = SAMPLE):
    """A foreachBatch function that keeps the sample of a whole stream: each batch is merged with what was kept before.

    Batch n is written beside batch n - 1, which a replay of n reads again; older ones are not read any more.
    """

    def write(batch: DataFrame, number: int) -> None:
        old = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}") if number else batch.limit(0)
        merged(bottom_k(batch, keys, id, k), old, keys=keys, id=id, k=k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
