"""WARC archives: written by Spark's text sink, read back with segments reassembled.

Writing is a DataFrame job: the record separator of the format is the line separator of the text sink, so
archives go to any file system that Spark writes. Long HTTP blocks are cut into a first record and continuation
records; bodies have chunked transfer framing. Of equal payloads, one is a response and the others revisit it.

Reading unpacks each archive as a stream in one Arrow pass: what is in memory is the packed file, as it was read,
and a record at a time. Whole records are decoded at once; only segments are shuffled:
they are grouped by their origin, ordered by number, checked for gaps and against the total length, joined, and
then decoded.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundphrase.llm.common import join_counted, new_path, small_batches, stored, table

#: Bytes in a segment and in a chunk, about: cuts are between characters.
SEGMENT, CHUNK = 1 << 16, 1 << 14
#: Records in one archive file at most. A record has a segment at most, so an archive has some 64 MB before compression
#: however long pages are.
RECORDS_PER_FILE = 1000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD = "record_id string, record_type string, page_id long, refers_to long, payload_digest string, origin string, segment int, total long, block binary, payload binary"
ARROW = pa.schema([*((c, pa.string()) for c in ("record_id", "record_type")), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("payload", pa.binary())])


def base32_of(digest: Column | str) -> Column:
    """Hex as bare upper-case base32: 20 bits, 5 hex or 4 base32 digits, at a time (160 bits)."""
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def cut(raw: bytes, width: int) -> Iterator[bytes]:
    """UTF-8 text in parts of width bytes or up to three more, none inside a character; none if it is empty."""
    at = 0
    while at < len(raw):
        end = at + width
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        yield raw[at:end]
        at = end


def record(page: int | None, url: str | None, body: bytes, digest: str, revisit: bool, response: int | None) -> Iterator[bytes]:
    """The record of a page, with its continuations, each without the two line ends that follow it."""
    name = lambda i: f"urn:page:{'null' if i is None else i}:{digest}"
    block = b"" if revisit else b"".join([HTTP, *(b"%X\r\n%b\r\n" % (len(x), x) for x in cut(body, CHUNK)), b"0\r\n\r\n"])
    parts = [*cut(block, SEGMENT)] or [b""]
    uri = [] if url is None else [f"WARC-Target-URI: {re.sub('[\\x00-\\x20\\x7f]', '%20', url)}"]
    for k, part in enumerate(parts, 1):
        head = ["WARC/1.1", f"WARC-Type: {'continuation' if k > 1 else 'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name(page)}{f':{k}' * (k > 1)}>", f"WARC-Date: {DATE}", *uri]
        if k == 1:
            head.append(f"WARC-Payload-Digest: sha1:{digest}")
        else:
            head.append(f"WARC-Segment-Origin-ID: <{name(page)}>")
        if revisit:
            head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{name(response)}>"]
        if len(parts) > 1:
            head.append(f"WARC-Segment-Number: {k}")
            if k == len(parts):
                head.append(f"WARC-Segment-Total-Length: {len(block)}")
        head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(part)}", "", ""]
        yield "\r\n".join(head).encode() + part


def _recorded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = [v for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for v in record(*row)]
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()).cast(pa.string())], names=["value"])


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """One row `value` for each WARC record. See write_warc."""
    small_batches(pages.sparkSession)
    p = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("body"))
    p = p.withColumn("digest", F.sha1("body"))
    groups = p.where(F.octet_length("body") >= min_bytes).groupBy("digest").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n"))
    # Only payloads that come again are joined; their pages find the response among few rows.
    again, _ = stored(groups.where("n > 1"), "payloads")
    p = join_counted(p, again, "digest", "n")
    revisit = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")) & (F.octet_length("body") >= min_bytes)
    return p.select("id", "url", "body", base32_of("digest").alias("digest"), revisit.alias("revisit"), "response").mapInArrow(_recorded, "value string")


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> None:
    """Write a record for each row of pages to gzip archives in path.

    Of rows with equal payloads of min_bytes or more, those with the largest id are responses and the others
    revisits of it; so repeated rows are alike, and null ids are the smallest. Null payloads count as empty, null
    URLs give no header, white space and controls in a URL become %20. Other columns are not carried.
    """
    options = {"lineSep": "\r\n\r\n", "compression": "gzip", "maxRecordsPerFile": str(RECORDS_PER_FILE)}
    records(pages, page_id, url, payload, min_bytes).write.options(**options).text(path)


def dechunk(body: bytes) -> bytes:
    """The data of a chunked HTTP body; ValueError if its framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block, out of its transfer coding."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("HTTP header is cut short")
    return dechunk(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head) else body


def parse(f: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive, one record at a time."""
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record before byte {f.tell()}")
        head = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        block = f.read(int(head["content-length"]))
        if f.read(4) != b"\r\n\r\n":
            raise ValueError(f"record before byte {f.tell()} is cut short")
        yield head, block


def _page(name: str | None) -> int | None:
    got = re.match(r"<urn:page:(-?\d+):", name or "")
    return int(got[1]) if got else None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    for b in batches:
        for content in b.column(0):
            rows, size = [], 0
            for head, block in parse(gzip.open(pa.BufferReader(content.as_buffer()))):
                kind, number, name = head["warc-type"], head.get("warc-segment-number"), head["warc-record-id"]
                if kind not in ("response", "revisit", "continuation"):
                    continue
                whole = number is None
                digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                rows.append((
                    name, kind, _page(name), _page(head.get("warc-refers-to")), digest, None if whole else head.get("warc-segment-origin-id", name), None if whole else int(number),
                    int(x) if (x := head.get("warc-segment-total-length")) else None, None if whole else block, payload_of(block) if whole and kind == "response" else None,
                ))
                size += len(block)
                if size > 4 << 20 or len(rows) >= 512:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for origin, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parts.sort(key=lambda x: x["segment"])
            if [x["segment"] for x in parts] != [*range(1, len(parts) + 1)]:
                raise ValueError(f"{origin}: segments are missing")
            block = b"".join(x["block"] for x in parts)
            if parts[-1]["total"] != len(block):
                raise ValueError(f"{origin}: {len(block)} bytes, not {parts[-1]['total']}")
            out.append(payload_of(block))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["origin", "payload"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of all archives in path: record_id, record_type, page_id, refers_to (page ids),
    payload_digest (as its header says) and payload (null for a revisit).

    A record is given as often as it is there. ValueError if a segment is missing or its total length is wrong.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    rows, _ = stored(files.mapInArrow(_parsed, RECORD), "records")  # each archive is parsed once
    plain = ["record_id", "record_type", "page_id", "refers_to", "payload_digest", "payload"]
    parts = rows.where("segment is not null").groupBy("origin", "segment").agg(F.first("total", ignorenulls=True).alias("total"), F.first("block").alias("block"), F.max("payload_digest").alias("payload_digest"), F.count(F.lit(1)).alias("copies"))
    heads = F.max(F.when(F.col("segment") == 1, F.col("copies"))).alias("copies"), F.max("payload_digest").alias("payload_digest")
    whole = parts.groupBy("origin").agg(F.collect_list(F.struct("segment", "total", "block")).alias("parts"), *heads)
    text = whole.select("origin", "parts").mapInArrow(_joined, "origin string, payload binary")
    text = text.join(whole.select("origin", "copies", "payload_digest"), "origin").select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    page = F.regexp_extract("origin", r"<urn:page:(-?\d+):", 1).try_cast("long").alias("page_id")
    segmented = text.select(F.col("origin").alias("record_id"), F.lit("response").alias("record_type"), page, F.lit(None).cast("long").alias("refers_to"), "payload_digest", "payload")
    return rows.where("segment is null").select(plain).unionByName(segmented)


def digests(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (both of the full payload, as read back), record_type, refers_to.

    A revisit takes them from the response that it names. A digest that differs from its header's fails.
    """
    read = read.withColumn("own", base32_of(F.sha1("payload")))
    checked = F.when(F.col("record_type") == "revisit", F.col("payload_digest")).when(F.col("own") == F.col("payload_digest"), F.col("own")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), "record_id")))
    rows, _ = stored(read.select("page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest")), "warc")
    responses = rows.where("record_type = 'response'")
    size = responses.groupBy("payload_digest").agg(F.max("payload_bytes").alias("size"))
    revisits = rows.where("record_type = 'revisit'").drop("payload_bytes")
    counts = revisits.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"))
    revisits = join_counted(revisits, size.join(counts, "payload_digest"), "payload_digest", "n").withColumnRenamed("size", "payload_bytes")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(cols).unionByName(revisits.select(cols))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, through archives and back; write_warc() and read_warc() say what becomes of nulls, ties and repeats."""
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return digests(read_warc(spark, path))


QUERIES = {"op3_warc": op3_warc}
ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m
"""
}
