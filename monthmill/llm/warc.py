"""WARC archives with a two-level capture index.

Archives: one gzip member per record, HTTP response or revisit. Index: captures sorted by reversed-host URL key and
cut into compressed blocks; a sparse directory beside each shard has the first key, place and size of every block. A
lookup finds its shards by the first keys of all shards (one row for each index task), its blocks by binary search in
the directory, its captures by binary search in the block, and reads the records by range. Tasks write files under
new names in the shared folder; only the rows of a task that succeeded name them, so a repeated task does no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from monthmill.llm.common import folder, query, stored, table

BLOCK_LINES, ARCHIVE_BYTES, MIN_REVISIT_BYTES = 1000, 1 << 30, 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, archive string, offset long, length long"


def storage(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder in shared storage."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host, then path and query; without scheme, user, default port, www and fragment."""
    url = clean_url(url)
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError:
        return url
    if not parts.hostname:
        return url
    host = parts.hostname.removeprefix("www.")
    shown = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + shown + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record(
    kind: str, page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None
) -> bytes:
    """One gzip member. A revisit keeps the HTTP header, whose Content-Length is that of the payload left out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += payload or b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append(f"WARC-Target-URI: {clean_url(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    outer = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(outer["Content-Length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    return outer, dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:]), payload


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return None if number == "None" else int(number)


def write_archives(pages: DataFrame, target: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record for each row of (page_id, url, html); returns the captures.

    Rows are compressed where they are read; what is shuffled, by payload, is the compressed record, and a revisit is
    cut down to its header after the join.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    same = F.sha2(F.col("html").cast("binary"), 256)
    winners = stored(pages.select("page_id", same.alias("same")).groupBy("same").agg(F.max("page_id").alias("first")), "winners")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = part.to_pylist()
                data = [r["html"].encode() for r in rows]
                digests = [sha1(d) for d in data]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([url_key(r["url"]) for r in rows], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()), pa.array(digests, pa.string()),
                    pa.array([len(d) for d in data], pa.int64()),
                    pa.array([record("response", r["page_id"], r["url"], d, len(d), s, None) for r, d, s in zip(rows, data, digests)], pa.binary()),
                ], ["page_id", "url", "key", "same", "digest", "bytes", "member"])

    packed = pages.mapInArrow(
        pack, "page_id long, url string, key string, same string, digest string, bytes long, member binary"
    )
    again = (F.col("bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = packed.join(winners, "same").select(
        "page_id", "url", "key", "digest", "bytes", F.when(again, F.col("first")).alias("refers_to"),
        F.when(~again, F.col("member")).alias("member"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = storage(target)
        store.create_dir(path, recursive=True)
        out = name = None
        for batch in batches:
            rows, places = batch.to_pylist(), []
            for r in rows:
                member = r["member"]
                if member is None:
                    member = record("revisit", r["page_id"], r["url"], None, r["bytes"], r["digest"], r["refers_to"])
                if out is None or out.tell() > ARCHIVE_BYTES:
                    if out:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                places.append((r["key"], r["page_id"], name, out.tell(), len(member)))
                out.write(member)
            if places:
                columns = [pa.array(c, t) for c, t in zip(zip(*places), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "page_id", "archive", "offset", "length"])
        if out:
            out.close()

    return stored(joined.mapInArrow(write, CAPTURE), "captures")


@dataclass
class CaptureIndex:
    """Folder of the shards; name, first and last key of each shard, in order of the keys."""

    target: str
    shards: list[tuple[str, str, str]]


def write_index(captures: DataFrame, target: str, lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sort captures by key into compressed blocks with a sparse directory; any number of rows may share a key."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = storage(target)
        store.create_dir(path, recursive=True)
        name, directory, first, last, held = uuid.uuid4().hex, [], None, None, []
        with store.open_output_stream(f"{path}/{name}.blocks", compression=None) as out:

            def flush() -> None:
                block = zlib.compress("\n".join("\t".join(x) for x in held).encode(), 6)
                directory.append(f"{held[0][0]}\t{out.tell()}\t{len(block)}")
                out.write(block)
                held.clear()

            for batch in batches:
                for r in batch.to_pylist():
                    first, last = (r["key"] if first is None else first), r["key"]
                    page = "" if r["page_id"] is None else str(r["page_id"])
                    held.append((r["key"], page, r["archive"], str(r["offset"]), str(r["length"])))
                    if len(held) == lines:
                        flush()
            if held:
                flush()
        if first is not None:
            with store.open_output_stream(f"{path}/{name}.directory", compression=None) as out:
                out.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_pydict({"shard": [name], "first": [first], "last": [last]})

    order = ["key", "page_id", "archive", "offset"]
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # one row for each index task
    rows = stored(ranged.mapInArrow(write, "shard string, first string, last string"), "shards").collect()
    return CaptureIndex(target, sorted(((r.shard, r.first, r.last) for r in rows), key=lambda s: s[1:]))


def lookup(index: CaptureIndex, keys: DataFrame) -> DataFrame:
    """Captures of the distinct keys in (key); every capture of a key is returned, whatever shards it spans."""
    firsts, lasts = [s[1] for s in index.shards], [s[2] for s in index.shards]
    names = [s[0] for s in index.shards]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (names[i], k) for k in batch.column(0).to_pylist()
                for i in range(bisect_left(lasts, k), bisect_right(firsts, k))
            ]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([s for s, _ in found], pa.string()), "key": pa.array([k for _, k in found], pa.string())
            })

    target = index.target

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = storage(target)
        shard = file = block = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, block = r["shard"], None
                    with store.open_input_stream(f"{path}/{shard}.directory", compression=None) as f:
                        directory = [x.split("\t") for x in f.read().decode().split("\n")]
                    starts = [d[0] for d in directory]
                    file = store.open_input_file(f"{path}/{shard}.blocks")
                # captures of a key may begin in the block before the first block that starts with it
                for b in range(max(0, bisect_left(starts, r["key"]) - 1), bisect_right(starts, r["key"])):
                    if b != block:
                        block, (_, offset, length) = b, directory[b]
                        data = zlib.decompress(file.read_at(int(length), int(offset))).decode()
                        lines = [x.split("\t") for x in data.split("\n")]
                        line_keys = [x[0] for x in lines]
                    hits = lines[bisect_left(line_keys, r["key"]):bisect_right(line_keys, r["key"])]
                    if hits:
                        yield pa.RecordBatch.from_pydict({
                            "key": [h[0] for h in hits],
                            "page_id": pa.array([int(h[1]) if h[1] else None for h in hits], pa.int64()),
                            "archive": [h[2] for h in hits], "offset": [int(h[3]) for h in hits],
                            "length": [int(h[4]) for h in hits],
                        })

    wanted = keys.select("key").distinct().mapInArrow(assign, "shard string, key string")
    # as many tasks as shards: their searches are long, though their keys are few bytes
    return wanted.repartition(max(1, len(names)), "shard").sortWithinPartitions("shard", "key").mapInArrow(search, CAPTURE)


def read_records(captures: DataFrame, target: str) -> DataFrame:
    """Read captured records by range: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    A response's digest is computed from what was read and must be the stored one.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = storage(target)
        name = file = None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(i, 256).to_pylist():
                    if r["archive"] != name:
                        name = r["archive"]
                        file = store.open_input_file(f"{path}/{name}")
                    outer, http, payload = parse(file.read_at(r["length"], r["offset"]))
                    kind, digest = outer["WARC-Type"], outer["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and sha1(payload) != digest:
                        raise ValueError(f"damaged record in {name} at {r['offset']}")
                    refers = page_of(outer["WARC-Refers-To"]) if kind == "revisit" else None
                    out.append((page_of(outer["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, refers,
                                payload.decode() if kind == "response" else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [
                        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ranged.mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
    )


def archive(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> tuple[CaptureIndex, str, DataFrame]:
    """Archives and index of a table of pages: (index, archive folder, captures).

    Null html is an empty payload, a null URL has the empty key. Of rows with equal payloads of `min_bytes` or more,
    that with the largest page_id is stored, the others refer to it; rows that repeat its id are stored too. Rows
    without an id refer to a row with one, and are stored if there is none. An empty table gives no files.
    """
    spark = pages.sparkSession
    target = folder(spark, "archives")
    captures = write_archives(pages, target, min_bytes)
    return write_index(captures, folder(spark, "index")), target, captures


@query("op7_warc")
def op7_warc(spark: SparkSession, root: str) -> DataFrame:
    index, target, captures = archive(table(spark, root, "pages"))
    # every URL is looked up in the index and its records are read from the archives
    found = stored(lookup(index, captures.select("key")), "found")  # the ranges below sample their input first
    return read_records(found, target).drop("payload")
