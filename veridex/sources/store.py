"""A record store with one row a key: buckets by hash of the key, of which an update touches only its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


class KeyedStore:
    """Records below a path, at <path>/buckets=<n>/bucket=<k>; a record is the row of greatest `order` of its key.

    upsert reads and rewrites the buckets of its rows and no others (dynamic partition overwrite, put in place when
    the job commits). add only adds files, so that small batches cost what they hold; reads take the latest row all
    the same, and compact() rewrites the buckets that have gathered many files. Writing the same rows again changes
    nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str = "id", order: str = "timestamp", buckets: int = 64):
        self.spark, self.key, self.order, self.buckets = spark, key, order, buckets
        self.path = f"{path}/buckets={buckets}"
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        self._stored = StructType(self.schema.fields + [StructField("bucket", IntegerType())])
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(self.path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`").cast("string")), F.lit(self.buckets)).cast("int")

    def _files(self, buckets: list[int] | None = None) -> DataFrame:
        stored = self.spark.read.schema(self._stored).parquet(self.path)
        return stored if buckets is None else stored.filter(F.col("bucket").isin(buckets))

    def _latest(self, rows: DataFrame) -> DataFrame:
        """The row of the greatest order of each key; of equal ones the greatest in its values."""
        own = [f"`{c}`" for c in self.schema.names]
        rank = F.struct(F.col(f"`{self.order}`"), *[F.col(f"`{c}`") for c in self.schema.names if c not in (self.key, self.order)])
        return rows.groupBy("bucket", F.col(f"`{self.key}`").alias("_key")).agg(F.max_by(F.struct(*own), rank).alias("_row")).select("bucket", "_row.*")

    def _write(self, rows: DataFrame, mode: str) -> None:
        w = rows.select(*[f"`{c}`" for c in self.schema.names], "bucket").repartition("bucket")  # a file a bucket
        w.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def add(self, rows: DataFrame) -> None:
        """Store rows without reading any."""
        self._write(self._latest(rows.withColumn("bucket", self.bucket())), "append")

    def upsert(self, rows: DataFrame) -> list[int]:
        """Store rows and leave their buckets in one file each; the buckets touched, at most all there are."""
        new = rows.withColumn("bucket", self.bucket())
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
        if touched:
            self._write(self._latest(self._files(touched).unionByName(new)), "overwrite")
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        """Remove the records of keys (a column named like the key). A bucket that is emptied keeps a row of nulls, which reads pass over."""
        gone = keys.select(f"`{self.key}`").distinct().withColumn("bucket", self.bucket())
        touched = sorted(r["bucket"] for r in gone.select("bucket").distinct().collect())
        if touched:
            left = self._latest(self._files(touched)).join(gone, [self.key, "bucket"], "left_anti")
            marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], "bucket")
            self._write(left.unionByName(marks), "overwrite")
        return touched

    def compact(self, most_files: int = 8) -> list[int]:
        """Rewrite the buckets that have more files than that."""
        files = self._files().select("bucket", F.col("_metadata.file_path").alias("f")).groupBy("bucket").agg(F.count_distinct("f").alias("n"))
        many = sorted(r["bucket"] for r in files.filter(F.col("n") > most_files).collect())
        if many:
            self._write(self._latest(self._files(many)), "overwrite")
        return many

    def read(self) -> DataFrame:
        """All records. Keys meet by bucket, so that nothing but a bucket's rows is shuffled together."""
        return self._latest(self._files().filter(F.col(f"`{self.key}`").isNotNull())).drop("bucket")

    def lookup(self, *keys) -> DataFrame:
        """The records of some keys: their buckets' files only, and of these by the key."""
        places = self.spark.createDataFrame([(str(k),) for k in keys], "k string").select(F.pmod(F.xxhash64("k"), F.lit(self.buckets)).cast("int").alias("b")).distinct()
        found = self._files([r["b"] for r in places.collect()]).filter(F.col(f"`{self.key}`").isin(*keys))
        return self._latest(found).drop("bucket")

    def sink(self):
        """A foreachBatch function that upserts micro-batches; a replayed batch changes nothing."""
        return lambda batch, number: self.upsert(batch) and None
