"""WARC archives written and read by index: offset, length, URL and digest of each record, then coalesced ranges.

Each record is a gzip member of its own, so that its bytes can be read alone. Payloads are deflated once, before
rows are dealt out, and the finished streams are put into records. A task writes one archive under a name of its
own attempt; only the index that Spark commits names the archives that count, so lost tasks leave no trace.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridex.llm.common import fresh_path, partitions, ship, slices, written

#: Equal payloads under so many bytes are not revisits.
LEAST_REVISIT = 100
LEVEL = 4
SALTS = 32
RANGE_BYTES, GAP_BYTES = 8 << 20, 64 << 10
_HEAD = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff"


def deflated(payload: bytes) -> bytes:
    """A deflate stream that can be followed by more blocks."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    return c.compress(payload) + c.flush(zlib.Z_SYNC_FLUSH)


def _stored(data: bytes, last: bool) -> bytes:
    out = []
    for at in range(0, max(1, len(data)), 65535):
        some = data[at : at + 65535]
        out.append(bytes([last and at + 65535 >= len(data)]) + struct.pack("<HH", len(some), len(some) ^ 0xFFFF) + some)
    return b"".join(out)


def record(page_id, url: str | None, digest: str, payload_bytes: int, stream: bytes | None, refers_to, place: str = "") -> bytes:
    """One gzip member: a response with its payload, or a revisit (stream is None) without.

    place: what no other record has; the record's id is made from it, as pages may repeat.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    kind = "response" if stream is not None else "revisit"
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>", f"WARC-Page-ID: {page_id}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (payload_bytes if stream is not None else 0)}",
    ]
    if stream is None:
        head += [f"WARC-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    start, end = "\r\n".join(head).encode() + b"\r\n\r\n" + http, b"\r\n\r\n"
    crc, size = zlib.crc32(start), len(start) + len(end)
    if stream is not None:
        payload = zlib.decompressobj(-15).decompress(stream)
        crc, size = zlib.crc32(payload, crc), size + len(payload)
    crc = zlib.crc32(end, crc)
    return b"".join([_HEAD, _stored(start, False), stream or b"", _stored(end, True), struct.pack("<II", crc, size & 0xFFFFFFFF)])


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda x: dict(line.split(": ", 1) for line in x.decode().split("\r\n")[1:] if ": " in line)
    warc = fields(head)
    block = rest[: int(warc["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't fit its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def revisits(keys: DataFrame) -> DataFrame:
    """page_id, refers_to of pages that repeat an equal payload; keys: page_id, payload_digest, payload_bytes."""
    large = keys.filter((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
    firsts = large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    # the pages of a very common payload are dealt over SALTS keys
    large = large.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    firsts = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return large.join(firsts, ["payload_digest", "_salt"]).filter("page_id <> refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def archived(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as archives in `folder`; the index: file, offset, length, page_id, url, digest, type."""
    spark = pages.sparkSession
    ship(spark)
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", F.sha2(body.cast("binary"), 256).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"), body.alias("html"))
    again = revisits(rows.drop("html", "url"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("stream", T.BinaryType())])

    def deflate(batches):
        for b in slices(batches, "html"):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([deflated(x.encode()) for x in b.column("html").to_pylist()], pa.binary())], names=schema.names)

    # a merge join even where the other side is small: its exchange keeps the two Python steps in different stages
    full = rows.mapInArrow(deflate, schema).join(again.withColumnsRenamed({"page_id": "_p", "payload_digest": "_d"}).hint("merge"), (F.col("page_id") == F.col("_p")) & (F.col("payload_digest") == F.col("_d")), "left").drop("_p", "_d")
    id_kind = pages.schema["page_id"].dataType
    index = T.StructType([T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("page_id", id_kind), T.StructField("url", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType())])

    def write(batches):
        from pyspark import TaskContext

        out, at = None, 0
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        for b in slices(batches, "stream"):
            if out is None:
                system, path = _file_system(name)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            offsets, lengths, kinds = [], [], []
            for page_id, url, digest, size, stream, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "payload_bytes", "stream", "refers_to"))):
                made = record(page_id, url, digest, size, None if first is not None else stream, first, f"{name}#{at}")
                out.write(made)
                offsets.append(at)
                lengths.append(len(made))
                kinds.append("response" if first is None else "revisit")
                at += len(made)
            yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), b.column("page_id"), b.column("url"), b.column("payload_digest"), pa.array(kinds)], names=index.names)
        if out is not None:
            out.close()

    return written(full.mapInArrow(write, index), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the indexed records, read from the archives.

    Records are sorted by place and their ranges coalesced: gaps of up to GAP_BYTES are read over, a read holds up
    to RANGE_BYTES. The digest of a response is taken from its payload; that of a revisit from its header.
    """
    spark = index.sparkSession
    ship(spark)
    id_kind = index.schema["page_id"].dataType
    schema = T.StructType([T.StructField("page_id", id_kind), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType())])
    placed = index.select("file", "offset", "length", "page_id", "payload_digest").repartitionByRange(partitions(spark), "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches):
        opened = (None, None)
        for b in batches:
            files, offsets, lengths = b.column("file").to_pylist(), b.column("offset").to_numpy(), b.column("length").to_numpy()
            k = 0
            while k < b.num_rows:
                m, end = k + 1, offsets[k] + lengths[k]
                while m < b.num_rows and files[m] == files[k] and offsets[m] - end <= GAP_BYTES and offsets[m] + lengths[m] - offsets[k] <= RANGE_BYTES:
                    end = offsets[m] + lengths[m]
                    m += 1
                if opened[0] != files[k]:
                    system, path = _file_system(files[k])
                    opened = (files[k], system.open_input_file(path))
                data = opened[1].read_at(int(end - offsets[k]), int(offsets[k]))
                rows = []
                for j in range(k, m):
                    a = int(offsets[j] - offsets[k])
                    warc, http, payload = parsed(data[a : a + int(lengths[j])])
                    named = warc["WARC-Payload-Digest"].removeprefix("sha256:")
                    first = None
                    if warc["WARC-Type"] == "response":
                        if hashlib.sha256(payload).hexdigest() != named:
                            raise ValueError(f"{files[j]} at {offsets[j]}: the payload doesn't fit its digest")
                    else:
                        first = warc["WARC-Refers-To-Page-ID"]
                    rows.append((int(http["Content-Length"]), named, warc["WARC-Type"], first))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column("page_id").slice(k, m - k), pa.array(cols[0], pa.int64()), *[pa.array(c, pa.string()) for c in cols[1:]]], names=schema.names)
                k = m

    return placed.mapInArrow(run, schema).withColumn("refers_to", F.col("refers_to").cast(id_kind))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page as a record, then read all records back by the index.

    Null html is an empty payload, a null URL an empty target. Pages without a page_id are responses; rows that
    repeat the page_id of the response are responses too. An empty table gives no rows.
    """
    return read_records(archived(pages.select("page_id", "url", "html"), fresh_path(pages.sparkSession, "warc")))
