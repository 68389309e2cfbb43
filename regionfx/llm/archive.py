"""WARC archives with a two-level capture index.

Records are gzip members of archive files.  The index sorts captures by
reversed-host URL key into compressed blocks; a sparse directory at the end of
each index file holds the first key, place and size of every block.  A lookup
finds the file and the block by binary search and reads one block and then one record
by range.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import zlib
from urllib.parse import urlsplit

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionfx.llm.storage import materialize, new_folder, open_filesystem, write_bytes

MAGIC = b"RFXCDX01"
BLOCK = 512  # captures of an index block
FILE_BYTES, READ_BYTES = 64 << 20, 2 << 20
CAPTURES_PER_TASK = 5_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "key string, page_id long, uri string, offset long, length long"


def url_key(url: str | None) -> str:
    """Reversed-host key: ``com,example,www)/path?query``; what isn't a URL is kept as it is, null is empty."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "//" in text else "//" + text)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return text
    if not host:
        return text
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, compressed as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_header(url or '')}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """The fields of a record; a response's digest is that of the payload read, a revisit's that of its header."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != stated):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda x: None if x is None or x == "<urn:page:None>" else int(x[10:-1])
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": stated, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row (page_id, url, html; null html: empty) and return the captures (key, page_id, uri, offset, length).

    Of rows with equal payloads of at least ``least_bytes`` bytes those with the largest page_id
    are responses, the others (null ids too) revisit it.  Only hashes with more than one
    row are joined back, from a written table, so a hot payload can be split by
    Spark.  An empty table gives no captures.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("hash"))
    repeated = rows.where(F.octet_length("html") >= least_bytes).groupBy("hash").agg(F.count("*").alias("n"), F.max("page_id").alias("first_id")).where("n > 1 and first_id is not null").select("hash", "first_id")
    repeated = materialize(repeated, "repeated-payloads")
    joined = rows.join(repeated, "hash", "left").select("page_id", "url", "html", "first_id")

    def write(batches):
        import pyarrow as pa

        part, file_no = TaskContext.get().partitionId(), 0
        members, entries, size = [], [], 0

        def flush():
            nonlocal members, entries, size, file_no
            uri = f"{folder}/part-{part:06d}-{file_no:06d}.warc.gz"
            write_bytes(uri, members)
            keys, ids, offsets, lengths = zip(*entries, strict=True)
            out = pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "page_id": pa.array(ids, pa.int64()), "uri": pa.array([uri] * len(ids), pa.string()), "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64())})
            members, entries, size, file_no = [], [], 0, file_no + 1
            return out

        for batch in batches:
            for page_id, url, text, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                member = record(page_id, url, text.encode(), first, first is not None and page_id != first, date)
                entries.append((url_key(url), page_id, size, len(member)))
                members.append(member)
                size += len(member)
                if size >= FILE_BYTES:
                    yield flush()
        if entries:
            yield flush()

    return materialize(joined.mapInArrow(write, CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures by (key, page_id) over index files; (uri, first_key, first_id, captures), one row per file, in order.

    Keys of one hot host or URL are told apart by page_id, so ranges stay even.
    """
    ordered = captures.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("key", "page_id", "row").sortWithinPartitions("key", "page_id", "row").drop("row")

    def write(batches):
        import pyarrow as pa

        rows, blocks, size, directory, first, n = [], [], 0, [], None, 0

        def block():
            nonlocal rows, size
            data = zlib.compress("\n".join(json.dumps(r) for r in rows).encode())
            directory.append((rows[0][0], rows[0][1], size, len(data)))
            blocks.append(data)
            size, rows = size + len(data), []

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, n = first or r, n + 1
                rows.append(r)
                if len(rows) == BLOCK:
                    block()
        if rows:
            block()
        if first:
            tail = zlib.compress(json.dumps(directory).encode())
            uri = f"{folder}/part-{TaskContext.get().partitionId():06d}.idx"
            write_bytes(uri, [*blocks, tail, struct.pack("<QQ8s", size, len(tail), MAGIC)])
            yield pa.RecordBatch.from_pydict({"uri": pa.array([uri]), "first_key": pa.array([first[0]], pa.string()), "first_id": pa.array([first[1]], pa.int64()), "captures": pa.array([n], pa.int64())})

    return materialize(ordered.mapInArrow(write, "uri string, first_key string, first_id long, captures long"), "index-files")


def order(key: str, page_id) -> tuple:
    """Sort order of captures: by the key's UTF-8 bytes, null ids first."""
    return key.encode(), page_id is not None, page_id or 0


class CaptureIndex:
    """Binary search over one index file's directory; the block read last is kept."""

    def __init__(self, uri: str):
        filesystem, path = open_filesystem(uri)
        self.file = filesystem.open_input_file(path)
        at = self.file.size() - 24
        start, length, magic = struct.unpack("<QQ8s", self.file.read_at(24, at))
        if magic != MAGIC:
            raise ValueError(f"not a capture index: {uri}")
        self.directory = json.loads(zlib.decompress(self.file.read_at(length, start)))
        self.first = [order(d[0], d[1]) for d in self.directory]
        self.held, self.rows = -1, []

    def block(self, i: int) -> list:
        if i != self.held:
            _, _, offset, length = self.directory[i]
            self.held, self.rows = i, [json.loads(x) for x in zlib.decompress(self.file.read_at(length, offset)).split(b"\n")]
            self.keys = [order(r[0], r[1]) for r in self.rows]
        return self.rows

    def find(self, key: str, page_id) -> list:
        """All captures of a key and page, over as many blocks as they fill."""
        want, out = order(key, page_id), []
        i = max(0, bisect.bisect_left(self.first, want) - 1)
        while i < len(self.first) and self.first[i] <= want:
            rows = self.block(i)
            lo, hi = bisect.bisect_left(self.keys, want), bisect.bisect_right(self.keys, want)
            out += rows[lo:hi]
            i += 1
        return out


def look_up(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Captures (page_id, uri, offset, length) of (key, page_id) rows by way of the index files.

    The list of files (one row for each task that wrote the index) is all that
    tasks hold of the index; blocks are read by range.  Each distinct key is
    looked up once, next to its neighbours.
    """
    files = sorted((order(r["first_key"], r["first_id"]), r["uri"], r["captures"]) for r in index.collect())
    firsts, uris = [f for f, _, _ in files], [u for _, u, _ in files]
    tasks = max(1, sum(n for _, _, n in files) // CAPTURES_PER_TASK)  # stated, as the rows are too small to be spread by their bytes
    ordered = keys.distinct().repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")

    def find(batches):
        import pyarrow as pa

        held, index = -1, None
        for batch in batches:
            out = []
            for key, page_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                want = order(key, page_id)
                i = max(0, bisect.bisect_left(firsts, want) - 1)
                while i < len(firsts) and firsts[i] <= want:
                    if i != held:
                        held, index = i, CaptureIndex(uris[i])
                    out += [r[1:] for r in index.find(key, page_id)]
                    i += 1
            a = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), pa.array(a[1], pa.string()), pa.array(a[2], pa.int64()), pa.array(a[3], pa.int64())], names=["page_id", "uri", "offset", "length"])

    return ordered.select("key", "page_id").mapInArrow(find, "page_id long, uri string, offset long, length long")


def read_records(captures: DataFrame) -> DataFrame:
    """The records of captures (uri, offset, length), each archive's in the order of their places; tasks get about READ_BYTES each."""
    captures = materialize(captures.select("uri", "offset", "length"), "found")
    tasks = max(1, -(-(captures.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    ordered = captures.repartitionByRange(tasks, "uri", "offset").sortWithinPartitions("uri", "offset")

    def read(batches):
        import pyarrow as pa

        held, file = None, None
        for batch in batches:
            out = []
            for uri, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if uri != held:
                    filesystem, path = open_filesystem(uri)
                    held, file = uri, filesystem.open_input_file(path)
                out.append(parse(file.read_at(length, offset)))
            column = lambda k, t: pa.array([r[k] for r in out], t)
            yield pa.RecordBatch.from_arrays([column("page_id", pa.int64()), column("url", pa.string()), column("payload_bytes", pa.int64()), column("payload_digest", pa.string()), column("record_type", pa.string()), column("refers_to", pa.int64())], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return ordered.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def capture_keys(pages: DataFrame) -> DataFrame:
    """(key, page_id) of pages."""

    def keys(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string()), batch.column("page_id")], names=["key", "page_id"])

    return pages.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(keys, "key string, page_id long")


def op5_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = new_folder(spark, "archives")
    index = write_index(write_archives(pages, folder), folder)
    return read_records(look_up(capture_keys(pages), index)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
