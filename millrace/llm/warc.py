"""Operator 8: WARC archives of pages, written with segmentation and read back.

Writing: of pages with equal payloads of at least LEAST_SHARED bytes the one with the smallest id is stored as a
response, the others as revisits of it. Payloads are framed in chunked transfer coding; a record's block of more
than `SEGMENT` characters is cut into a first record and continuation records that name the first as their
origin. Spark's text sink writes the records, so every file is committed or absent, on any file system. A file
holds at most `RECORDS_PER_FILE` records, and a record at most a segment, which bounds what a reader holds.

What tells which payloads are shared is found on ids and digests alone; the pages themselves are not shuffled as
long as the shared digests are few enough to be broadcast (`MOST_BROADCAST`), and beyond that they are.

Reading: files are parsed record by record by their Content-Length. Records that are whole become pages where they
lie. Segments, which may lie in different files, are grouped by the identifier of their origin and ordered by segment
number in a distributed sort, and their total length is verified. The transfer framing is decoded, and the payload's
digest is compared with the one in the header. Records of other types (warcinfo, request, metadata) are passed over.

Defined results: null html is the empty payload; null urls have no target; rows with a null page_id are stored
without one and come back with null; repeated rows that are the smallest of their payload are all responses; a
payload of any length is stored whole, in as many segments as it takes; an empty table gives an archive without
records and no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._text import row_type
from millrace.session import in_batches, materialize

LEAST_SHARED, SEGMENT, CHUNK, RECORDS_PER_FILE, MOST_BROADCAST = 100, 48_000, 16_000, 8_000, 500_000
_END, _DATE = "\r\n\r\n", "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(text: str, size: int = CHUNK) -> str:
    parts = (text[i : i + size] for i in range(0, len(text), size))
    return "".join([*(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts), "0", _END])


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        if body[line + 2 + n : line + 4 + n] != b"\r\n":
            raise ValueError("a chunk is not as long as its head says")
        out.append(body[line + 2 : line + 2 + n])
        at = line + 4 + n


def _record(headers: list[tuple[str, object]], block: str) -> str:
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", len(block.encode()))] if v is not None]
    return "\r\n".join(["WARC/1.1", *lines]) + _END + block


def records(row: str, page: object, url: str | None, html: str, digest: str, size: int, refers_to: object) -> Iterator[str]:
    """The WARC records of a page; `row` makes its identifier."""
    own = f"<urn:millrace:{row}>"
    target = None if url is None else "".join(c if c not in "\r\n" else f"%{ord(c):02X}" for c in url)
    common = [("WARC-Record-ID", own), ("WARC-Date", _DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", _PROFILE), ("X-Refers-To-Page", refers_to)], f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{_END}")
        return
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked{_END}{chunked(html)}"
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = len(block.encode()) if k == len(parts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:millrace:{row}:{k}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part)


def _write(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    task, n, out, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "bytes", "refers_to")]
        for i in range(batch.num_rows):
            for record in records(f"{task}-{n}", *(c[i].as_py() for c in columns)):
                out.append(record)
                size += len(record)
            n += 1
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], schema=schema)
                out, size = [], 0
    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], schema=schema)


def write(pages: DataFrame, path: str) -> None:
    """Archives of `pages` (page_id, url, html) as gzip files in the folder `path`."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    shared = F.col("bytes") >= LEAST_SHARED
    groups = pages.select("page_id", "digest", "bytes").where(shared).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(groups.select("digest", "first"))
    if first.count() <= MOST_BROADCAST:
        first = F.broadcast(first)
    refers = F.when(shared & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    kind, arrow = row_type("record string")
    found = pages.join(first, "digest", "left").select("page_id", "url", F.when(refers.isNull(), F.col("html")).otherwise("").alias("html"), "digest", "bytes", refers.alias("refers_to"))
    found.transform(in_batches, lambda it: _write(it, arrow), kind).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive that comes in pieces."""
    held = b""
    head: dict[str, str] | None = None
    for piece in stream:
        held += piece
        at = 0
        while True:
            if head is None:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                version, *lines = held[at:end].decode().split("\r\n")
                if not version.startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {version[:40]!r}")
                head, at = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}, end + 4
            size = int(head["content-length"])
            if len(held) < at + size + 4:
                break
            if held[at + size : at + size + 4] != b"\r\n\r\n":
                raise ValueError("a record is not as long as its head says")
            yield head, held[at : at + size]
            head, at = None, at + size + 4
        held = held[at:]
    if held or head is not None:
        raise ValueError("the archive ends within a record")


def _inflated(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    while raw:  # one gzip member after another
        z, at = zlib.decompressobj(31), 0
        while not z.eof and at < len(raw):
            yield z.decompress(raw[at : at + step])
            at += step
        yield z.flush()
        raw = z.unused_data + raw[at:]


_PAGES, _NUMBER = ("response", "revisit", "continuation"), "warc-segment-number"
_FIELDS = ("warc-type", "x-page-id", "warc-target-uri", "warc-payload-digest", "x-refers-to-page")
_ROW = "origin string, segment int, total long, type string, page string, url string, digest string, refers_to string, block binary"


def _parsed(contents: pa.Array) -> Iterator[tuple[bool, tuple]]:
    """(whether it is a segment, its row) of each record of pages in archives."""
    for raw in contents:
        for head, block in parse(_inflated(raw.as_py())):
            if head.get("warc-type") in _PAGES:
                total = head.get("warc-segment-total-length")
                yield _NUMBER in head, (head.get("warc-segment-origin-id", head["warc-record-id"]), int(head.get(_NUMBER, 1)), None if total is None else int(total), *(head.get(f) for f in _FIELDS), block)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some 4 MB; a batch holds one row at least."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(v) for v in row if isinstance(v, bytes))
        if size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from _batched((row for batch in batches for segment, row in _parsed(batch.column("content")) if segment), schema)


def _whole(batches: Iterator[pa.RecordBatch], with_payload: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pages = (_page([row]) for batch in batches for segment, row in _parsed(batch.column("content")) if not segment)
    yield from _batched((p if with_payload else p[:-1] for p in pages), schema)


def _page(segments: list[tuple]) -> tuple:
    """The page that a response's or revisit's segments, in order, make."""
    _, _, _, kind, page, url, digest, refers_to, _ = segments[0]
    block = b"".join(s[-1] for s in segments)
    if [s[1] for s in segments] != list(range(1, len(segments) + 1)) or len(segments) > 1 and segments[-1][2] != len(block):
        raise ValueError(f"segments of page {page} are missing or of a wrong length")
    head, body = block.split(b"\r\n\r\n", 1)
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in head.decode().split("\r\n")[1:])}
    digest = digest.removeprefix("sha256:")
    if kind == "revisit":
        return page, url, int(fields["content-length"]), digest, kind, refers_to, None
    payload = dechunked(body) if fields.get("transfer-encoding") == "chunked" else body
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"page {page} does not have its digest")
    return page, url, len(payload), digest, kind, refers_to, payload


def _assembled(batches: Iterator[pa.RecordBatch], with_payload: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pages from segments sorted by origin and number; holds one page's segments at a time."""

    def pages() -> Iterator[tuple]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, own in itertools.groupby(rows, key=lambda row: row[0]):
            page = _page(list(own))
            yield page if with_payload else page[:-1]

    yield from _batched(pages(), schema)


def read(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """page_id (a string), url, payload_bytes, payload_digest, record_type, refers_to and (with_payload) payload of each page.

    The archives are inflated twice, for records that are whole and for segments: that is less than a shuffle of all.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    kind, pages = row_type("page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload)
    stored, arrow = row_type(_ROW)
    whole = files.transform(in_batches, lambda it: _whole(it, with_payload, pages), kind)
    segments = files.transform(in_batches, lambda it: _segments(it, arrow), stored).repartition("origin").sortWithinPartitions("origin", "segment")
    return whole.unionByName(segments.transform(in_batches, lambda it: _assembled(it, with_payload, pages), kind))
