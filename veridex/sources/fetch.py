"""Payloads of listed places, read by a Python data source: addresses are judged before, sizes while reading, kinds after.

A list has key, url, hops (where redirects led, in order), location, offset and length of each payload. Judging is
done by expressions, hop by hop; the list is written with its verdicts, a part for each partition of the reading.
Places are files in a store that all tasks reach; nothing is fetched over the network.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from veridex.functions import net
from veridex.shipping import shared_dir, ship
from veridex.sources.files import image_type

MOST_BYTES = 15 << 20
MOST_REDIRECTS = 3
BATCH_BYTES = 8 << 20
SCHEMA = "key string, url string, bytes bigint, content binary, error string"


def refusal(url: str, hops: Column, most_redirects: int = MOST_REDIRECTS, allow_http: bool = False) -> Column:
    """Why an address may not be fetched: the first error among it and its redirects, each judged anew; null if it may."""

    def one(u: Column) -> Column:
        host = net.url_parts(u)["host"]
        literal = net.is_ip_literal(host) & net.ip_reason(host).isNotNull()
        return F.coalesce(net.verdict(u, allow_http), F.when(literal, "BLOCKED_URL"))

    all_ = F.concat(F.array(F.col(url)), F.coalesce(hops, F.array().cast("array<string>")))
    found = F.filter(F.transform(all_, one), lambda e: e.isNotNull())
    return F.coalesce(F.get(found, 0), F.when(F.size(all_) - 1 > most_redirects, "DOWNLOAD_FAILED"))


class Part(InputPartition):
    """One file of the list."""

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class ListReader(DataSourceReader):
    def __init__(self, options: dict):
        self.list, self.most = options["list"], int(options.get("maxBytes", MOST_BYTES))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.list)
        found = store.get_file_info(fs.FileSelector(path))
        return [Part(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.startswith("part-") and f.size] or [Part("")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        import json

        from pyarrow import fs

        if not part.path:  # an empty list
            return
        store, _ = fs.FileSystem.from_uri(self.list)
        names, rows, held = [c.split()[0] for c in SCHEMA.split(", ")], [], 0
        with store.open_input_stream(part.path) as lines:
            listed = [json.loads(x) for x in lines.read().splitlines() if x]
        for entry in listed:
            size, content, error = entry.get("length") or 0, None, entry.get("refused")
            if error is None and size > self.most:  # by what is declared, before anything is read
                error = "DOWNLOAD_TOO_LARGE"
            if error is None:
                try:
                    content = self.payload(entry)
                    error = "DOWNLOAD_TOO_LARGE" if len(content) > self.most else None
                except (OSError, pa.ArrowException) as e:
                    error = f"DOWNLOAD_FAILED: {type(e).__name__}"
            content = None if error else content
            rows.append((entry["key"], entry.get("url"), None if content is None else len(content), content, error))
            held += len(content or b"")
            if held > BATCH_BYTES:
                yield self.batch(rows, names)
                rows, held = [], 0
        if rows:
            yield self.batch(rows, names)

    def payload(self, entry: dict) -> bytes:
        """At most one byte more than the limit, whatever was declared."""
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(entry["location"])
        with store.open_input_file(path) as f:
            f.seek(entry.get("offset") or 0)
            return f.read(min(entry["length"] if entry.get("length") is not None else self.most + 1, self.most + 1))

    def batch(self, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class ListedFiles(DataSource):
    """spark.read.format("listed_files").option("list", folder of JSON lines): one partition a file of the list."""

    @classmethod
    def name(cls) -> str:
        return "listed_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ListReader(self.options)


def fetched(listed: DataFrame, most_bytes: int = MOST_BYTES, most_redirects: int = MOST_REDIRECTS, allow_http: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """key, url, bytes, content, error and image_type of every entry of listed (key, url, hops, location, offset, length).

    Either content or error is null. Errors: those of the address rules for it or a redirect, DOWNLOAD_TOO_LARGE
    (declared or read), DOWNLOAD_FAILED, and UNSUPPORTED_MEDIA_TYPE where the first bytes tell none of `kinds` (all
    are allowed without). Null hops are none, a null length reads to the end. Entries are read one after the other in
    as many tasks as listed has partitions; one that fails doesn't stop the others.
    """
    spark: SparkSession = listed.sparkSession
    ship(spark)
    spark.dataSource.register(ListedFiles)
    place = f"{shared_dir(spark)}/list-{uuid.uuid4().hex}"
    place = place if "://" in place else f"file://{place}"
    listed.select(F.col("key").cast("string").alias("key"), "url", "location", F.col("offset").cast("bigint").alias("offset"), F.col("length").cast("bigint").alias("length"), refusal("url", F.col("hops"), most_redirects, allow_http).alias("refused")).write.json(place)
    got = spark.read.format("listed_files").option("list", place).option("maxBytes", str(most_bytes)).load().withColumn("image_type", image_type("content"))
    if kinds is None:
        return got
    bad = F.col("error").isNull() & ~F.coalesce(F.col("image_type").isin(kinds), F.lit(False))
    return got.select("key", "url", F.when(~bad, F.col("bytes")).alias("bytes"), F.when(~bad, F.col("content")).alias("content"), F.when(bad, "UNSUPPORTED_MEDIA_TYPE").otherwise(F.col("error")).alias("error"), "image_type")


def payload_files(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, location, offset, length of payloads, which each partition puts into one file of the shared folder.

    The places are written as a table as well, so that only the files of tasks that were committed count.
    """
    from pyspark import TaskContext

    spark = rows.sparkSession
    ship(spark)
    place = f"{shared_dir(spark)}/payloads-{uuid.uuid4().hex}"
    place = place if "://" in place else f"file://{place}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(place)
        store.create_dir(path, recursive=True)
        name = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{path}/{name}") as out:
            for b in batches:
                data, at = b.column(1).to_pylist(), out.tell()
                lengths = [len(x or b"") for x in data]
                for x in data:
                    out.write(x or b"")
                offsets = list(accumulate(lengths, initial=at))[:-1]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"{place}/{name}"] * len(data)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "location", "offset", "length"])

    kind = rows.schema[key].dataType.simpleString()
    schema = f"key {kind}, location string, offset bigint, length bigint"
    rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{content}`").cast("binary").alias("content")).mapInArrow(run, schema).write.parquet(f"{place}-places")
    return spark.read.schema(schema).parquet(f"{place}-places")
