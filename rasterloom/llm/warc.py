"""WARC archives with a two-level capture index.

Archives are written where the pages lie, one file per task, one gzip member per record; a
repeated payload becomes a revisit of its first page. The index sorts captures by their
reversed-host URL key into compressed blocks; every index file ends with the sparse
directory of its blocks, and a list of the files' first keys, one per partition, stands
above. A fetch searches the list, the directory and the block by bisection, then reads the
record's byte range.

Files lie under the shared folder and are opened through the file system of its URI. A
task that is run again writes a file of its own name, and only the rows of the run that
counts point to it.
"""

from __future__ import annotations

import bisect
import gzip
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_BYTES = 100
BLOCK = 256
#: WARC-Date of records whose page has no fetch time.
DATE = "2024-01-01T00:00:00Z"
#: Line breaks within a URL, which would end its header.
BREAKS = {10: "%0A", 13: "%0D"}
CAPTURES = "key string, page_id long, file string, offset long, length long"


def surt(url: Column) -> Column:
    """Reversed-host key: host labels back to front, then the path; no scheme, port, fragment or leading www."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^(?:[^/?@]*@)?([^/?:]*)", 1)), "^www\\d*\\.", "")
    path = F.regexp_extract(rest, "^[^/?]*(.*)$", 1)
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, "\\."))), F.lit(")"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member: a response with its payload, or a revisit without it."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    revisit = refers_to is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url.translate(BREAKS)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record."""
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    return headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class Archive:
    """Where the files of one write lie: captures (rows CAPTURES) and first keys of the index files."""

    def __init__(self, root: str, captures: DataFrame, tops: list[tuple[str, str]]):
        self.root, self.captures, self.tops = root, captures, tops


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, bytes, digest, refers_to (null for responses)."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    all_ = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    all_ = all_.select("*", F.length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"))
    again = all_.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = common.materialize(again, "payloads")
    typed = all_.join(again, "digest", "left")
    return typed.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write(pages: DataFrame) -> Archive:
    """Write a record per row of pages (page_id, url, html) and the index of them.

    A null html is an empty payload, a null url an empty one, a null page_id a record without a
    number (a response). Of payloads of at least LEAST_BYTES bytes that occur again the row with the
    smallest page_id is the response; repeated rows with that page_id are responses too. Other
    columns are ignored; an empty table gives an archive without records.
    """
    spark = pages.sparkSession
    root = common.scratch(spark, "warc")

    def store(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(root)
        files.create_dir(base, recursive=True)
        name, offset = f"part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}.warc.gz", 0
        sink = None
        for batch in it:
            out: list[tuple] = []
            for key, page_id, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "url", "payload", "digest", "refers_to")), strict=True):
                sink = sink or files.open_output_stream(f"{base}/{name}", compression=None)
                data = record(page_id, url, payload, digest, refers_to)
                sink.write(data)
                out.append((key, page_id, name, offset, len(data)))
                offset += len(data)
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["key", "page_id", "file", "offset", "length"])
        if sink:
            sink.close()

    typed = with_types(pages).select(surt(F.col("url")).alias("key"), "page_id", "url", "payload", "digest", "refers_to")
    captures = common.materialize(typed.mapInArrow(store, CAPTURES), "captures")
    return Archive(root, captures, indexed(captures, root))


def indexed(captures: DataFrame, root: str) -> list[tuple[str, str]]:
    """Write the index files; returns the first key and name of each, one per partition."""

    def store(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (row for batch in it for row in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True))
        files, base = opened(root)
        name, directory, offset, held = f"index-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}.cdx", [], 0, []
        sink = None

        def flush() -> None:
            nonlocal offset, held, sink
            sink = sink or files.open_output_stream(f"{base}/{name}", compression=None)
            data = gzip.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode(), 6, mtime=0)
            directory.append((held[0][0], offset, len(data)))
            sink.write(data)
            offset, held = offset + len(data), []

        for row in lines:
            held.append(row)
            if len(held) == BLOCK:
                flush()
        if held:
            flush()
        if sink:
            data = gzip.compress(json.dumps(directory, ensure_ascii=False).encode(), 6, mtime=0)
            sink.write(data + struct.pack("<QQ", offset, len(data)))
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]] if directory else [], pa.string()), pa.array([name] if directory else [], pa.string())], ["key", "file"])

    n = common.partitions(captures.sparkSession)
    ordered = captures.repartitionByRange(n, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    made = common.materialize(ordered.mapInArrow(store, "key string, file string"), "index")
    return [(r["key"], r["file"]) for r in made.orderBy("key", "file").collect()]


class Reader:
    """Finds captures by key and reads their records, keeping the blocks it is in."""

    def __init__(self, root: str, tops: list[tuple[str, str]]):
        self.files, self.base = opened(root)
        self.tops, self.open, self.directories, self.block = tops, {}, {}, (None, [])
        self.keys = [k for k, _ in tops]

    def range(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.files.open_input_file(f"{self.base}/{name}")
        return self.open[name].read_at(length, offset)

    def directory(self, name: str) -> list[list]:
        if name not in self.directories:
            size = self.files.get_file_info(f"{self.base}/{name}").size
            at, length = struct.unpack("<QQ", self.range(name, size - 16, 16))
            self.directories = {name: json.loads(zlib.decompress(self.range(name, at, length), 31))}
        return self.directories[name]

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the blocks that may hold key: the list and the directories are bisected."""
        for top in range(max(0, bisect.bisect_left(self.keys, key) - 1), bisect.bisect_right(self.keys, key)):
            name = self.tops[top][1]
            directory = self.directory(name)
            firsts = [d[0] for d in directory]
            for k in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
                yield name, directory[k][1], directory[k][2]

    def find(self, key: str, name: str, offset: int, length: int) -> Iterator[list]:
        """Captures of key in one block, oldest page first: the block is bisected."""
        if self.block[0] != (name, offset):
            data = zlib.decompress(self.range(name, offset, length), 31)
            self.block = (name, offset), [json.loads(x) for x in data.decode().split("\n")]
        lines = self.block[1]
        i = bisect.bisect_left(lines, key, key=lambda x: x[0])
        while i < len(lines) and lines[i][0] == key:
            yield lines[i]
            i += 1


def fetch(archive: Archive, keys: DataFrame) -> DataFrame:
    """All records of the distinct keys (column key): page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    The payload of a revisit is null: it is that of the page it refers to.
    """
    root, tops = archive.root, archive.tops

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(root, tops)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * 7
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])

        for batch in it:
            out, size = [], 0
            for ask in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                for _, _, name, offset, length in reader.find(*ask):
                    warc, http, payload = parsed(reader.range(name, offset, length))
                    revisit = warc["WARC-Type"] == "revisit"
                    out.append((int(warc["X-Page-ID"]) if warc["X-Page-ID"] else None, warc["WARC-Target-URI"], warc["WARC-Type"], int(warc["X-Refers-To-Page-ID"]) if revisit else None, warc["WARC-Payload-Digest"].removeprefix("sha256:"), int(http["Content-Length"]), None if revisit else payload))
                    size += len(payload)
                    if size >= common.SLICE_BYTES:
                        yield batch_of(out)
                        out, size = [], 0
            yield batch_of(out)

    def locate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(root, tops)
        for batch in it:
            out = [(key, *block) for key in batch.column("key").to_pylist() for block in reader.blocks(key)]
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["key", "file", "offset", "length"])

    # keys in the order of the index, so that a task bisects few directories; then a task per
    # few blocks, so that a key with many captures is read by many tasks
    n = common.partitions(keys.sparkSession)
    asked = keys.select("key").distinct().repartitionByRange(n, "key").sortWithinPartitions("key")
    placed = asked.mapInArrow(locate, "key string, file string, offset long, length long")
    return placed.repartition(n, "file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, then fetch every page by its URL key; a response's digest and length are taken of what was read."""
    pages = common.table(spark, sf_dir, "pages")
    archive = write(pages)
    got = fetch(archive, archive.captures)
    read = F.col("payload").isNotNull()
    return got.select(
        "page_id",
        F.when(read, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(read, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE_OP4 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(encode(coalesce(html, ''))) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
