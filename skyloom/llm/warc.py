"""WARC archives of pages and a two-level capture index.

Records are gzip members of .warc.gz files in the shared folder. The index holds one line for each capture, sorted by
a key of the reversed host, in compressed blocks; a sparse directory has the first key of each block. A lookup
searches the directory, then the block, then reads byte ranges of the archives. Records whose payload equals another's
and that do not have the largest page_id of these are revisits; payloads under `min_bytes` never are.

Null html is an empty payload. A null url has an empty key and no target header. A null page_id never is the largest:
its record revisits, unless all of its kind are null. Rows that repeat a page_id and payload are each a record.
Extra columns are left alone; an empty table gives empty archives and results.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.files import make_folder, open_fs, write_bytes
from skyloom.functions.shared import materialize, shared_path

BLOCK_LINES = 3000
#: The directory comes to the driver and is broadcast; blocks grow so that it has no more entries than this.
MAX_BLOCKS = 200_000
ARCHIVE_BYTES = 1 << 30


def surt(url: str | None) -> str:
    """A sort key: host parts reversed, then port, path and query; scheme, user and a leading www are left out."""
    url = quote(url or "", safe="".join(map(chr, range(33, 127)))).strip()
    rest = url.split("://", 1)[-1]
    cut = min([i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0], default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:].split("#", 1)[0]
    name, _, port = host.partition(":")
    parts = name.split(".")
    if len(parts) > 2 and parts[0] == "www":
        parts = parts[1:]
    return f"{','.join(reversed(parts))}{':' + port if port else ''}){path or '/'}" if url else ""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One uncompressed WARC record; a revisit has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """What a record says of itself; of a response the payload is measured and digested, of a revisit it is quoted."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    number = lambda urn: int(urn[len("<urn:x-page:") : -1]) if len(urn) > len("<urn:x-page:>") else None
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": number(fields["WARC-Record-ID"]), "payload_bytes": int(said["Content-Length"]) if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"][5:] if revisit else digest(payload),
        "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To"]) if revisit else None,
    }


@dataclass
class CaptureIndex:
    """captures: the written records (key, page_id, file, begin, size); directory: first key, file and place of each
    block, in order of keys."""

    captures: DataFrame
    directory: list[tuple[str, str, int, int]]


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html); returns the captures.

    Only digests that occur more than once are joined back, so the hot side of the join is pages' own, which Spark can
    split. Files are named anew by each attempt; those of lost attempts are never referred to.
    """
    folder = shared_path(pages.sparkSession, "warc")
    make_folder(folder)
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = pages.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html"))
    copies = own.filter(F.col("size") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("times")).filter("times > 1").select(F.col("sha").alias("_sha"), "first")
    other = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    told = own.join(copies, (F.col("sha") == F.col("_sha")) & (F.col("size") >= min_bytes), "left")
    told = told.select("page_id", "url", "html", F.when(other, F.col("first")).alias("refers_to"))

    def run(batches):
        rows = ([batch.column(c)[i].as_py() for c in range(4)] for batch in batches for i in range(batch.num_rows))
        row = next(rows, None)
        while row is not None:
            name, made = f"{folder}/{uuid.uuid4().hex}.warc.gz", []

            def members(name=name, made=made):
                nonlocal row
                at = 0
                while row is not None and at < ARCHIVE_BYTES:
                    page, url, html, refers = row
                    member = gzip.compress(record(page, url, html.encode("utf-8", "surrogatepass"), refers), 1, mtime=0)
                    made.append((surt(url), page, name, at, len(member)))
                    at += len(member)
                    yield member
                    row = next(rows, None)

            write_bytes(name, members())
            for at in range(0, len(made), 10000):
                cols = zip(*made[at : at + 10000])
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "begin", "size"])

    return materialize(told.mapInArrow(run, "key string, page_id bigint, file string, begin bigint, size bigint"), "captures")


def build_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sort the captures by key, write them in compressed blocks and keep the first key of each."""
    spark = captures.sparkSession
    folder = shared_path(spark, "cdx")
    make_folder(folder)
    lines = max(block_lines, captures.count() // MAX_BLOCKS)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = captures.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "begin")

    def run(batches):
        made: list = []
        name = f"{folder}/{uuid.uuid4().hex}.cdx.gz"

        def blocks():
            held: list[str] = []
            at = 0

            def flush():
                nonlocal at, held
                raw = zlib.compress("\n".join(held).encode(), 6)
                made.append((held[0].split(" ", 1)[0], name, at, len(raw)))
                at += len(raw)
                held = []
                return raw

            for batch in batches:
                for key, page, file, begin, size in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "begin", "size"))):
                    held.append(f"{key} {'-' if page is None else page} {file} {begin} {size}")
                    if len(held) >= lines:
                        yield flush()
            if held:
                yield flush()

        write_bytes(name, blocks())
        if made:
            yield pa.record_batch([pa.array(c) for c in zip(*made)], ["first_key", "file", "begin", "size"])

    found = materialize(ordered.mapInArrow(run, "first_key string, file string, begin bigint, size bigint"), "directory")
    # files of one task hold one range of keys, blocks in order of their place
    return CaptureIndex(captures, sorted((tuple(r) for r in found.collect()), key=lambda b: (b[0].encode(), b[1], b[2])))


def lookup(index: CaptureIndex, keys: DataFrame) -> DataFrame:
    """The records of all captures under the given keys (column key): page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    Keys are sought in the directory by binary search; the wanted keys of a block meet in one task, which holds no more
    than a block: it reads the block's range, keeps the lines wanted and reads their ranges in order of place.
    """
    spark: SparkSession = keys.sparkSession
    directory = spark.sparkContext.broadcast(index.directory)

    def seek(batches):
        first = [b[0] for b in directory.value]
        for batch in batches:
            keys, blocks = [], []
            for key in batch.column("key").to_pylist():
                a = max(0, bisect_left(first, key) - 1)
                for block in range(a, bisect_right(first, key)):
                    keys.append(key)
                    blocks.append(block)
            yield pa.record_batch([pa.array(blocks, pa.int32()), pa.array(keys, pa.string())], ["block", "key"])

    def read(table: pa.Table) -> pa.Table:
        wanted = set(table.column("key").to_pylist())
        _, file, begin, size = directory.value[table.column("block")[0].as_py()]
        lines = zlib.decompress(next(read_range(file, [(begin, size)]))).decode().split("\n")
        places: dict[str, list] = {}
        for line in lines:
            key, _, name, begin, size = line.rsplit(" ", 4)
            if key in wanted:
                places.setdefault(name, []).append((int(begin), int(size)))
        rows = [parse(gzip.decompress(raw)) for name, ranges in places.items() for raw in read_range(name, sorted(ranges))]
        return pa.Table.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    # dealt by a number of its own: these rows are few bytes, but each stands for records that its task will read
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sought = keys.select("key").distinct().mapInArrow(seek, "block int, key string").repartition(tasks, "block")
    return sought.groupBy("block").applyInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def read_range(uri: str, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes at each (begin, size) of a file, one at a time: a block's records need not fit in memory together."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        for begin, size in ranges:
            f.seek(begin)
            yield f.read(size)
