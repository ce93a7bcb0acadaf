"""Writing pages as WARC archives and reading archives back record by record.

Every record is a gzip member of its own. Pages whose payload equals that of an earlier page (smaller
page_id) become revisit records without payload. The reader decompresses incrementally, frames each
record by its Content-Length and checks block and payload digests, holding one record's payload at most.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.blocks import record_batch, with_rows
from quayside.session import scratch

#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 18
MOST_HEADER_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "<urn:x-page:%s>"

WRITTEN = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
READ = pa.schema(
    [
        ("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
        ("target_uri", pa.string()), ("refers_to_id", pa.string()), ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()), ("verified", pa.bool_()), ("payload", pa.binary()),
    ]
)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(kind: str, record_id: str, block: bytes, content_type: str, **headers: str | None) -> bytes:
    """One WARC record as a gzip member. Header names use underscores for hyphens; null ones are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    lines += [f"{name.replace('_', '-')}: {value}" for name, value in headers.items() if value is not None]
    lines += [
        f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).digest())}",
        f"Content-Type: {content_type}",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None) -> bytes:
    """A response record, or a revisit of page ``first_id`` if that is given."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC_Target_URI": url and re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url),
        "WARC_Payload_Digest": f"sha1:{base32_sha1(hashlib.sha1(payload).digest())}",
    }
    kind, name = "application/http; msgtype=response", ID % ("null" if page_id is None else page_id)
    if first_id is None:
        return record("response", name, head + payload, kind, **headers)
    return record("revisit", name, head, kind, **headers, WARC_Profile=IDENTICAL, WARC_Refers_To=ID % first_id)


def with_first_copy(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """page_id, url, html and ``first_id``: the smallest page_id with an equal payload, where it is another page's.

    Only payloads of ``revisit_from`` bytes or more are compared. Digests are counted before anything is
    exchanged, and only digests with several pages are joined back, in a join whose hot keys Spark can split.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    several = (
        pages.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= revisit_from)
        .select(digest.alias("digest"), "page_id")
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first_id").isNotNull())
        .drop("n")
    )
    marked = pages.select("page_id", "url", "html").withColumn("digest", digest).join(several, "digest", "left")
    own = F.col("page_id").eqNullSafe(F.col("first_id"))
    return marked.select("page_id", "url", "html", F.when(~own, F.col("first_id")).alias("first_id"))


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 0) -> DataFrame:
    """Write all pages below ``folder``, a place that every executor reaches; return the archives written.

    Columns used: page_id, url, html; others are ignored. Null html is an empty payload. A page without id
    is a revisit if another page with an id has its payload, else a response; rows with the first copy's
    own id are all responses. Each task attempt writes files of its own names, and only those of attempts that
    succeed are listed, so that repeated attempts do no harm.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        scheme = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
        part, out, done = TaskContext.get().partitionId(), None, []
        for batch in with_rows(batches):
            for page_id, url, html, first_id in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    name = posixpath.join(root, f"pages-{part:06d}-{uuid.uuid4().hex}.warc.gz")
                    out, records, size = store.open_output_stream(name, compression=None), 0, 0
                    size += out.write(record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", b"format: WARC File Format 1.1\r\n", "application/warc-fields"))
                member = page_record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), first_id.as_py())
                size, records = size + out.write(member), records + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((scheme + name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((scheme + name, records, size))
        if done:
            yield record_batch(dict(zip(WRITTEN.names, zip(*done, strict=True), strict=True)), WRITTEN)

    listed = scratch(pages.sparkSession, "warc-list")
    with_first_copy(pages, revisit_from).mapInArrow(run, "file string, records long, bytes long").write.parquet(listed)
    return pages.sparkSession.read.parquet(listed)


class _Record:
    """A record under way: fed with decompressed bytes, it frames itself."""

    def __init__(self, keep_payload: bool) -> None:
        self.head, self.headers, self.left = b"", None, 0
        self.block_sha, self.payload_sha = hashlib.sha1(), hashlib.sha1()
        self.http, self.http_size, self.payload_size = None, None, 0
        self.payload, self.tail = ([] if keep_payload else None), b""

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            self.head += data
            head, mark, data = self.head.partition(b"\r\n\r\n")
            if not mark:
                if len(self.head) > MOST_HEADER_BYTES:
                    raise ValueError("a record's header does not end")
                return
            lines = head.decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise ValueError("a record does not start with its version")
            self.headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
            self.left = int(self.headers["content-length"])
            if "http" in self.headers.get("content-type", ""):
                self.http = b""
        block, data = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.block_sha.update(block)
        self._feed_block(block)
        self.tail += data
        if len(self.tail) > 4:
            raise ValueError("a record is longer than its Content-Length")

    def _feed_block(self, block: bytes) -> None:
        if self.http is not None:
            self.http += block
            head, mark, block = self.http.partition(b"\r\n\r\n")
            if not mark:
                return
            self.http = None
            stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            self.http_size = int(stated[1]) if stated else None
        self.payload_size += len(block)
        self.payload_sha.update(block)
        if self.payload is not None:
            self.payload.append(block)

    def row(self, file: str, offset: int) -> dict[str, object]:
        if self.headers is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError(f"{file}: the record at {offset} is cut short")
        says, kind = self.headers.get, self.headers.get("warc-type")
        digest = (says("warc-payload-digest") or "").removeprefix("sha1:") or None
        good = says("warc-block-digest", "").removeprefix("sha1:") == base32_sha1(self.block_sha.digest())
        if kind == "response":
            good &= digest == base32_sha1(self.payload_sha.digest()) and self.http_size in (None, self.payload_size)
        return {
            "file": file, "offset": offset, "record_type": kind, "record_id": says("warc-record-id"),
            "target_uri": says("warc-target-uri"), "refers_to_id": says("warc-refers-to"), "payload_digest": digest,
            "payload_bytes": self.http_size if kind == "revisit" else self.payload_size, "verified": good,
            "payload": b"".join(self.payload) if self.payload is not None else None,
        }


def records(stream, file: str, keep_payload: bool = True) -> Iterator[dict[str, object]]:
    """All records of one archive in order; a broken frame or gzip member is an error, a wrong digest is not ``verified``."""
    offset, data, unpack, current = 0, b"", None, None
    while data or (data := stream.read(CHUNK)):
        if unpack is None:
            unpack, current, size = zlib.decompressobj(31), _Record(keep_payload), 0
        size += len(data)
        while True:
            part = unpack.decompress(data, CHUNK)
            current.feed(part)
            data = unpack.unconsumed_tail
            if unpack.eof or (not data and len(part) < CHUNK):
                break
        data = unpack.unused_data
        size -= len(data)
        if unpack.eof:
            yield current.row(file, offset)
            offset, unpack = offset + size, None
    if unpack is not None:
        raise ValueError(f"{file}: the gzip member at {offset} is cut short")


def read_archives(archives: DataFrame, keep_payload: bool = True, tasks: int | None = None) -> DataFrame:
    """All records of the archives named in column ``file``, one sequential reader per archive."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in with_rows(batches):
            for file in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for row in records(stream, file, keep_payload):
                        rows.append(row)
                        size += len(row["payload"] or b"") + 400
                        if size > 8 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, READ)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, READ)

    files = archives.select("file")
    schema = (
        "file string, offset long, record_type string, record_id string, target_uri string, refers_to_id string, "
        "payload_digest string, payload_bytes long, verified boolean, payload binary"
    )
    return files.repartition(tasks or max(1, files.count()), "file").mapInArrow(run, schema)


def page_of(record_id: str):
    return F.regexp_extract(record_id, r"x-page:(-?\d+)>", 1).try_cast("long")


def archived_pages(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages, read all archives: per page what its record says. A damaged record is an error."""
    found = read_archives(write_archives(pages, folder), keep_payload=False)
    return found.where(F.col("record_type").isin("response", "revisit")).select(
        page_of("record_id").alias("page_id"),
        "payload_bytes",
        F.when(F.col("verified"), F.col("payload_digest"))
        .otherwise(F.raise_error(F.concat(F.lit("wrong digest in "), "file", F.lit(" at "), F.col("offset").cast("string"))))
        .alias("payload_digest"),
        "record_type",
        page_of("refers_to_id").alias("refers_to"),
        "target_uri",
    )
