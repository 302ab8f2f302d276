"""Web archives: pages to WARC/1.1 files and back.

Writing: one record per page, an HTTP response whose body is the payload in chunked transfer framing. Blocks longer
than SEGMENT_BYTES are cut into a first record and continuation records. Of pages with equal payloads of at least
MIN_REVISIT bytes the one with the smallest id is a response, the others are revisit records without a body. A record's
identifier is made of the page id and the payload's digest; rows that repeat both get the number of their partition and
row behind it, so that the segments of each stay apart.

Reading: each archive is parsed once. Continuation records are grouped by the identifier of their origin, ordered by
segment number, checked against the total length that the last one states, and joined; then the chunked framing is
taken off. A record whose segments are missing, repeated or of another total gets a null payload and complete = false.

A null payload is written as an empty one, a null address as about:blank. A null page id stays null; its page is never
the one that others revisit, unless no page with that payload has an id: then each is a response. Repeated pages, and
pages that share an id, give a record each. Very long pages are segmented; one page is one value. An empty table gives
an archive without records. Other columns are not read, whatever their names. Files hold at most FILE_RECORDS records,
so an archive file stays under FILE_RECORDS * (SEGMENT_BYTES + heads) bytes and is read as one value.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stage
from .textbytes import trimmed

SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
MIN_REVISIT = 100
#: Records in a file at most.
FILE_RECORDS = 8192
#: Hexadecimal digits of the digest in an identifier.
ID_DIGITS = 32
_DATE = "2024-01-01T00:00:00Z"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_URN = "urn:emberline:page:"

RECORD = "record_id string, record_type string, page_id long, uri string, payload_digest string, refers_to long, origin_id string, segment int, total_length long, block binary"


def chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for i in range(0, len(payload), CHUNK_BYTES) for p in (payload[i : i + CHUNK_BYTES],)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload, or None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return None
        if size == 0:
            return b"".join(out)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes | None) -> bytes | None:
    """Body of an HTTP response, with the chunked framing taken off where its head states it."""
    head, sep, body = (block or b"").partition(b"\r\n\r\n")
    if not sep:
        return None
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Date", _DATE), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def _urn(page_id: int | None, digest: str, row: str = "") -> str:
    return f"<{_URN}{'' if page_id is None else page_id}:{digest[:ID_DIGITS]}{row}>"


def _page_records(page_id: int | None, uri: str, payload: bytes, digest: str, first: int | None, row: str) -> Iterator[bytes]:
    """row: told apart from others of the same id and payload by this."""
    own, target = _urn(page_id, digest, row), ("WARC-Target-URI", " ".join(uri.split()) or "about:blank")
    kind, sums = ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")
    if first is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), target, kind, sums, ("WARC-Refers-To", _urn(first, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], _HEAD)
        return
    block = _HEAD + chunked(payload)
    base = [("WARC-Type", "response"), ("WARC-Record-ID", own), target, kind, sums]
    if len(block) <= SEGMENT_BYTES:
        yield _record(base, block)
        return
    parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    yield _record([*base, ("WARC-Segment-Number", "1")], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{k}>"), target, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k)), *total], part)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        out: list[bytes] = []
        size = 0
        for page_id, uri, payload, digest, first, again in zip(*(batch.column(i) for i in range(6)), strict=True):
            number += 1
            row = f":{task}.{number}" if again.as_py() else ""
            for r in _page_records(page_id.as_py(), uri.as_py(), payload.as_py().encode(), digest.as_py(), first.as_py(), row):
                out.append(r)
                size += len(r)
            if size > 4 << 20:
                yield pa.record_batch([pa.array(out, pa.binary())], ["record"])
                out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(out, pa.binary())], ["record"])


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html") -> None:
    """Writes gzip-compressed archives to path. The record separator is the line separator of the text writer."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(uri), F.lit("")).alias("uri"), body.alias("payload"), F.sha2(F.encode(body, "UTF-8"), 256).alias("digest"))
    # of payloads that occur again: their smallest page id, and whether one page has them twice
    each = rows.groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.max(F.octet_length("payload")).alias("size"))
    sums = each.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("n").alias("n"), (F.max("n") > 1).alias("again"), F.max("size").alias("size")).filter("n > 1")
    sums = sums.select("digest", F.when(F.col("size") >= MIN_REVISIT, F.col("first")).alias("first"), "again")
    rows = rows.join(sums, "digest", "left").select("page_id", "uri", "payload", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("first"), F.coalesce("again", F.lit(False)).alias("again"))
    records = rows.mapInArrow(trimmed(_write), "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _id(urn: str) -> int | None:
    tail = urn.strip("<>").removeprefix(_URN).split(":")[0]
    return int(tail) if tail.lstrip("-").isdigit() else None


def parse_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, with lower-case names, and block of each record."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


_SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary())])


def _records(content: pa.Scalar) -> Iterator[tuple]:
    """A tuple of _SCHEMA for each record of an archive."""
    raw = content.as_buffer()
    packed = raw.size >= 2 and raw.slice(0, 2).to_pybytes() == b"\x1f\x8b"
    stream = io.BufferedReader(gzip.open(io.BytesIO(raw), "rb"), 1 << 20) if packed else io.BytesIO(raw)
    for f, block in parse_archive(stream):
        number, own, origin = f.get("warc-segment-number"), f.get("warc-record-id", ""), f.get("warc-segment-origin-id")
        refers, total = f.get("warc-refers-to"), f.get("warc-segment-total-length")
        yield (own, f.get("warc-type"), _id(origin or own), f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha256:") or None, refers and _id(refers), origin or own, number and int(number), total and int(total), block)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size_of: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += size_of(row) + 200
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((r for b in batches for c in b.column(0) for r in _records(c)), _SCHEMA, lambda r: len(r[-1]))

    return _archives(spark, path).mapInArrow(trimmed(run), RECORD)


_OUT = "page_id long, uri string, record_type string, payload_digest string, refers_to long, payload binary, payload_bytes long, payload_sha256 string"
_DECODED = pa.schema([*(_SCHEMA.field(n) for n in ("page_id", "uri", "record_type", "payload_digest", "refers_to")), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string())])
_PARTS = pa.schema([*_DECODED, ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary())])


def _payload(record_type: str | None, block: bytes | None, texts: bool) -> tuple:
    """payload, its length and its digest; without texts only the last two."""
    whole = None if record_type == "revisit" else http_payload(block)
    return (whole if texts else None, None, None) if whole is None else (whole if texts else None, len(whole), hashlib.sha256(whole).hexdigest())


def _decoded(texts: bool):
    """Whole records with their payload, segments with their block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for content in batch.column(0):
                for _, kind, page_id, uri, digest, refers, origin, segment, total, block in _records(content):
                    head = (page_id, uri, kind, digest, refers)
                    yield (*head, *_payload(kind, block, texts), None, None, None, None) if segment is None else (*head, None, None, None, origin, segment, total, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(rows(batches), _PARTS, lambda r: len(r[5] or b"") + len(r[-1] or b""))

    return run


def _joined(texts: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            heads = zip(*(batch.column(n).to_pylist() for n in _DECODED.names[:5]), strict=True)
            for head, parts, total in zip(heads, batch.column("parts"), batch.column("total_length"), strict=True):
                data = [p["block"].as_py() for p in parts]
                whole = b"".join(data) if [p["segment"].as_py() for p in parts] == list(range(1, len(data) + 1)) else None
                yield *head, *_payload(head[2], whole if whole is not None and len(whole) == total.as_py() else None, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(rows(batches), _DECODED, lambda r: len(r[5] or b""))

    return run


def read_archives(spark: SparkSession, path: str, texts: bool = True) -> DataFrame:
    """A row per page: page_id, uri, record_type, payload_digest (as stated), refers_to, payload, payload_bytes and
    payload_sha256 (of what was read; these three are null for revisits), complete. Without texts payload is null."""
    schema = _OUT + ", origin_id string, segment int, total_length long, block binary"
    parsed = stage.persisted(_archives(spark, path).mapInArrow(trimmed(_decoded(texts)), schema), "warc-records")
    columns = _DECODED.names
    groups = parsed.filter("segment is not null").groupBy("origin_id").agg(
        F.first("page_id").alias("page_id"),
        F.max("uri").alias("uri"),
        F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"),
        F.max("payload_digest").alias("payload_digest"),
        F.max("refers_to").alias("refers_to"),
        F.max("total_length").alias("total_length"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    cut = groups.select(*columns[:5], "total_length", "parts").mapInArrow(trimmed(_joined(texts)), _OUT)
    return parsed.filter("segment is null").select(*columns).unionByName(cut).withColumn("complete", (F.col("record_type") == "revisit") | F.col("payload_bytes").isNotNull())


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """Length and digest of every page's full payload, those of revisits taken from the response they refer to."""
    rows = read_archives(spark, path, texts=False)
    rows = rows.select("page_id", "record_type", "refers_to", "payload_bytes", F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(F.col("payload_sha256")).alias("payload_digest"))
    rows = stage.persisted(rows, "warc-rows")
    revisit = rows.filter("record_type = 'revisit'").drop("payload_bytes")
    whole = rows.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    return rows.filter("record_type != 'revisit'").unionByName(revisit.join(whole, ["refers_to", "payload_digest"], "left").select(*rows.columns))
