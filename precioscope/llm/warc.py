"""Op 6: WARC archives with revisit resolution.

Only headers (page_id, digest, size) are shuffled by payload digest, with a map-side maximum, so a
payload that a third of all pages share costs one row per task.  Revisits are then joined to their
original responses and the records are written with fresh headers into gzip-member archives, held
as rows of a Parquet table (one archive segment a row): the file commit protocol of Spark's writer
makes them safe against lost executors, on any store.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precioscope.llm.scratch import Scratch

LEAST_BYTES = 1000
SEGMENT_BYTES = 4 << 20
#: No capture time is in the pages; records carry this fixed one, so that reruns agree.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def resolve_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages with payload_digest, payload_bytes, record_type and refers_to.

    Of pages with equal payloads of at least ``least_bytes`` the one with the largest page_id is the
    response (all rows of that page_id, if repeated); the others revisit it.  Null html is the empty
    payload; a null page_id never is an original, and stays a response where no other id has the
    payload.  Other columns and names do not matter; an empty table gives none.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select("page_id", "url", body.alias("payload"))
    heads = pages.select("page_id", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    large = heads.filter(F.col("payload_bytes") >= least_bytes)
    firsts = large.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1 and original is not null")
    revisits = large.join(firsts.select("payload_digest", "original"), "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("original")))
    # Bodies stay where they are unless the list of revisits is too large to be sent to them.
    revisits = revisits.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "original").distinct()
    own = pages.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    out = own.join(revisits, (F.col("page_id").eqNullSafe(F.col("_id"))) & (F.col("payload_digest") == F.col("_digest")), "left")
    return out.select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(F.col("original").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("original").alias("refers_to"))


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _uri(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record with fresh headers; a revisit carries no payload but the reference to it."""
    target = (url or _uri(page_id)).replace("\r", "%0D").replace("\n", "%0A")
    record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{_uri(page_id)}#{digest}")
    coded = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{coded}"), ("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        original = uuid.uuid5(uuid.NAMESPACE_URL, f"{_uri(refers_to)}#{digest}")
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{original}>"), ("X-Refers-To-Page", str(refers_to))]
        block = http
    else:
        block = http + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")]
    return _record(kind, fields, block)


def write_archives(resolved: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Rows (segment, archive): gzip WARC segments of about ``segment_bytes``, one member a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[bytes], records: int) -> pa.RecordBatch:
            archive = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(archive).hexdigest()]), pa.array([records], pa.int64()), pa.array([archive], pa.binary())], names=["segment", "records", "archive"])

        parts, size, records = [], 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                values = [batch.column(c)[i].as_py() for c in range(6)]
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                parts.append(packer.compress(make_record(*values)) + packer.flush())
                size, records = size + len(parts[-1]), records + 1
                if size >= segment_bytes:
                    yield out(parts, records)
                    parts, size, records = [], 0, 0
        if parts:
            yield out(parts, records)

    cols = ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
    return resolved.select(*cols).mapInArrow(run, "segment string, records long, archive binary")


STEP_BYTES = 1 << 14


def parse_archive(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; ValueError if lengths or digests do not hold."""
    view, at = memoryview(archive), 0
    while at < len(view):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof and at < len(view):  # in steps, so that what is left is never copied whole
            parts.append(unpacker.decompress(view[at : at + STEP_BYTES]))
            at += len(view[at : at + STEP_BYTES])
        if not unpacker.eof:
            raise ValueError("cut-off gzip member")
        at -= len(unpacker.unused_data)
        data = b"".join(parts)
        head, sep, block = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not sep or not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        n = int(fields["Content-Length"])
        if len(block) != n + 4 or block[n:] != b"\r\n\r\n":
            raise ValueError("wrong Content-Length")
        block = block[:n]
        if fields["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise ValueError("wrong block digest")
        yield fields, block


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record; the payload digest of a response is computed anew and must hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for fields, block in parse_archive(batch.column(0)[i].as_py()):
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size, kind = int(fields["X-Payload-Length"]), fields["WARC-Type"]
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size = len(payload)
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError("wrong payload digest")
                    number = lambda x: int(x) if x else None
                    rows.append((number(fields["X-Page-Id"]), size, digest, kind, number(fields.get("X-Refers-To-Page")), fields["WARC-Target-URI"]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ_SCHEMA.split(", ")])

    return archives.select("archive").mapInArrow(run, READ_SCHEMA)


def archive_pages(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Resolve revisits, write the deduplicated archives, read them back: one row per page."""
    scratch = Scratch(pages.sparkSession, "warc")
    return read_archives(scratch.cut(write_archives(resolve_revisits(pages, least_bytes)), "archives"))
