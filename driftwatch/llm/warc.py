"""WARC archives: pages written as records, long ones in segments, and read back by reassembling them."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm.common import new_folder, small_batches, staged

SEPARATOR = b"\r\n\r\n"
#: Bytes of a record's block beyond which it is written in segments, of an HTTP chunk, and records of one archive file.
SEGMENT, CHUNK, FILE_RECORDS = 16_384, 4_096, 4_096
#: Rows of a side that may be broadcast; each is two short columns.
BROADCAST_ROWS = 100_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_REVISIT = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _cuts(data: bytes, size: int) -> Iterator[bytes]:
    """data in parts of at most size bytes, none of which ends within a character."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in _cuts(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """What a chunked body carries; sizes may have extensions, and trailers may follow. ValueError if it breaks off."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk breaks off")
        out.append(body[end + 2 : at])
        at += 2


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message, its transfer framing decoded."""
    head, _, body = block.partition(SEPARATOR)
    framed = any(line.lower().replace(b" ", b"").startswith(b"transfer-encoding:chunked") for line in head.split(b"\r\n"))
    return unchunked(body) if framed else body


def _one_line(text: str) -> str:
    return " ".join(text.split())


def records(page_id, url: str | None, payload: bytes, refers_to, record_id: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, without what parts them: a response, in segments if it is long, or a revisit."""
    revisit = refers_to is not None
    block = _REVISIT if revisit else _HTTP + chunked(payload)
    parts = list(_cuts(block, segment))
    for k, part in enumerate(parts, 1):
        kind = ("revisit" if revisit else "response") if k == 1 else "continuation"
        own = record_id if k == 1 else str(uuid.uuid5(uuid.UUID(record_id), str(k)))
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{own}>", "WARC-Date: 2000-01-01T00:00:00Z"]
        if url is not None:
            lines.append(f"WARC-Target-URI: {_one_line(url)}")
        if page_id is not None:
            lines.append(f"Page-ID: {page_id}")
        if k == 1:
            lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
        if revisit:
            lines += [f"WARC-Profile: {_PROFILE}", f"Refers-To-Page-ID: {refers_to}"]
        if len(parts) > 1:
            lines.append(f"WARC-Segment-Number: {k}")
        if k > 1:
            lines.append(f"WARC-Segment-Origin-ID: <urn:uuid:{record_id}>")
        if k == len(parts) > 1:
            lines.append(f"WARC-Segment-Total-Length: {len(block)}")
        lines.append(f"Content-Length: {len(part)}")
        yield "\r\n".join(lines).encode("utf-8", "replace") + SEPARATOR + part


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, segment: int = SEGMENT) -> None:
    """Compressed archive files in folder, of FILE_RECORDS records each at most.

    Of pages whose payloads are equal and have min_bytes or more, those with the smallest id are written as response,
    the others as revisit. A null html is an empty payload. A null id is no one's copy: always a response. Only digests
    are shuffled to find copies, and pages only if more payloads than BROADCAST_ROWS repeat.
    """
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    sized = rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= min_bytes)).select("page_id", digest.alias("digest"))
    copied = staged(sized.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first"), "copied")
    few = copied.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.withColumn("digest", digest).join(F.broadcast(copied) if few else copied, "digest", "left")
    refers = F.when((F.col("page_id") > F.col("first")) & (F.octet_length("html") >= min_bytes), F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page, url, text, first in zip(*(c.to_pylist() for c in batch.columns)):
                for record in records(page, url, text.encode("utf-8", "replace"), first, str(uuid.uuid4()), segment):
                    out.append(record)
                    held += len(record)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    value = joined.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(run, "value string")
    value.write.option("lineSep", SEPARATOR.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def parse(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records from pieces of archives in order: headers, with names in lower case, and blocks.

    Line ends between records are passed over, however many there are: a file whose last block ends in one may be
    handed on with a separator too many.
    """
    buffer, at = bytearray(), 0
    for piece in stream:
        buffer += piece
        while True:
            while at < len(buffer) and buffer[at] in b"\r\n":
                at += 1
            if (end := buffer.find(SEPARATOR, at)) < 0:
                break
            head = bytes(buffer[at:end]).decode("utf-8", "replace").split("\r\n")
            if not head[0].startswith("WARC/"):
                raise ValueError(f"not a record: {head[0][:40]!r}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
            start = end + len(SEPARATOR)
            length = int(fields["content-length"])
            if len(buffer) < start + length + len(SEPARATOR):
                break
            yield fields, bytes(buffer[start : start + length])
            at = start + length
        if at > 1 << 20 or at == len(buffer):
            del buffer[:at]
            at = 0
    if buffer[at:].strip(b"\r\n"):
        raise ValueError("an archive breaks off within a record")


_SEGMENTS = "origin string, number int, total bigint, kind string, page_id bigint, url string, digest string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, block binary"


def _long(x: str | None) -> int | None:
    return None if x is None else int(x)


def read_segments(spark: SparkSession, folder: str, payloads: bool) -> DataFrame:
    """One row per record of the archives. Whole ones have their payload's size and digest, and itself if payloads; of
    segments the block is passed on. Compressed files aren't split, so each task sees the pieces of its files in order."""
    small_batches(spark)
    lines = spark.read.option("lineSep", SEPARATOR.decode()).schema("value string").text(folder).select(F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("block", pa.binary())])
        out, held = [], 0
        for f, block in parse(piece + SEPARATOR for batch in batches for piece in batch.column(0).to_pylist()):
            number = _long(f.get("warc-segment-number"))
            row = {
                "origin": f.get("warc-segment-origin-id") or f["warc-record-id"], "number": number, "total": _long(f.get("warc-segment-total-length")), "kind": f["warc-type"],
                "page_id": _long(f.get("page-id")), "url": f.get("warc-target-uri"), "digest": f.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": _long(f.get("refers-to-page-id")),
            }
            if number is not None:
                row["block"] = block
            elif row["kind"] == "response":
                payload = payload_of(block)
                row |= {"payload_bytes": len(payload), "payload_digest": base32_sha1(payload)} | ({"payload": payload} if payloads else {})
            out.append(row)
            held += len(block)
            if len(out) >= 1000 or held > 8 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return lines.mapInArrow(run, _SEGMENTS)


def reassemble(segments: DataFrame, payloads: bool) -> DataFrame:
    """Whole responses from rows with a segment number: joined in the order of their numbers, checked for gaps and
    against the total length, and decoded. What is incomplete raises an error."""
    parts = segments.where(F.col("number").isNotNull())
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    joined = parts.groupBy("origin").agg(first("page_id"), first("url"), first("digest"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                block = b"".join(p["block"] for p in row["parts"])
                if [p["number"] for p in row["parts"]] != list(range(1, len(row["parts"]) + 1)) or len(block) != row["total"]:
                    raise ValueError(f"segments of {row['origin']} are incomplete: {len(block)} of {row['total']} bytes")
                payload = payload_of(block)
                out.append((row["page_id"], row["url"], row["digest"], len(payload), base32_sha1(payload), payload if payloads else None))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "url", "digest", "payload_bytes", "payload_digest", "payload"])

    return joined.mapInArrow(run, "page_id bigint, url string, digest string, payload_bytes bigint, payload_digest string, payload binary")


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row per page in the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if payloads.

    Size, digest and payload of a revisit are those of the response with its digest. A payload whose digest isn't the
    one that its record names raises an error.
    """
    segments = staged(read_segments(spark, folder, payloads), "segments")
    columns = ["page_id", "url", "digest", "payload_bytes", "payload_digest", "payload"]
    responses = segments.where("number is null and kind = 'response'").select(columns).unionByName(reassemble(segments, payloads))
    differ = F.concat(F.lit("payload digest differs: "), F.col("payload_digest"))
    checked = responses.withColumn("payload_digest", F.when(F.col("digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(differ).cast("string")))
    revisits = segments.where("kind = 'revisit'").select("page_id", "url", "digest", "refers_to")
    values = ["payload_bytes", "payload_digest", "payload"] if payloads else ["payload_bytes", "payload_digest"]
    wanted = revisits.select(F.col("refers_to").alias("page_id"), "digest").distinct()
    known = checked.join(wanted, ["page_id", "digest"], "left_semi").groupBy("digest").agg(*(F.first(v).alias(v) for v in values))
    again = revisits.join(known, "digest").select("page_id", "url", *values, F.lit("revisit").alias("record_type"), "refers_to")
    return checked.select("page_id", "url", *values, F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to")).unionByName(again)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as archives in the shared folder and read them back, without the payloads.

    Repeated rows are written as often as they come; those that repeat the smallest id of a payload are all responses.
    Other columns are ignored, an empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "archives")
    write_archives(pages, folder, id_col, url_col, html_col)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
