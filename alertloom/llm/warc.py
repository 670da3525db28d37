"""WARC archives of pages: writing, and reading with segment reassembly and chunked transfer decoding."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.common import written

# A record's block and a chunk of a body hold at most so many bytes, a file so many records: a file
# is at most about 17 MB before compression, however long the pages are.
SEGMENT, CHUNK, RECORDS_PER_FILE = 32_768, 8_192, 512
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
_ID = "<urn:x-page:{}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The body in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0" + END


def unchunk(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, found, body = block.partition(END)
    if not found:
        raise ValueError("the response has no end of headers")
    return unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def page_records(page: object, url: str | None, payload: bytes, refers_to: object, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, named by its number: a revisit, or a response with its continuations."""
    origin = _ID.format(page)
    target = [("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))] if url else []
    common = [("WARC-Date", DATE), *target, ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", origin), ("WARC-Refers-To", _ID.format(refers_to)), ("WARC-Profile", PROFILE), *common], head)
        return
    block = head + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, *first], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", _ID.format(f"{page}/{k}")), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", k), *last], part)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file, one record at a time."""
    n = 0
    while line := stream.readline():
        n += 1
        if not line.startswith(b"WARC/"):
            raise ValueError(f"record {n} does not start as one")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]) or stream.read(4) != END:
            raise ValueError(f"record {n} has another length")
        yield fields, block


def write_archive(pages: DataFrame, path: str) -> None:
    """Writes a record for each of ``pages`` (page_id long, url string, html string) into gzipped WARC files under ``path``.

    The payload is the html in UTF-8, null html the empty payload.  Of pages with
    equal payloads that with the largest page_id is a response, the others are revisits of it.
    Blocks longer than 32 KiB are cut into a response and continuations.  Every row gets its record: one without page_id, or under a
    page_id that other rows have as well, is named by its row too.  Of rows of one page_id and payload any may be the response.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    name = F.col("page_id").cast("string")
    # In most tables every row has an id of its own; only else rows are numbered, and kept with their numbers.
    if not rows.groupBy("page_id").count().filter("count > 1 OR page_id IS NULL").isEmpty():
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
        first = rows.filter("page_id IS NOT NULL").groupBy("page_id").agg(F.min("row").alias("first"))
        rows = rows.join(first, "page_id", "left")
        name = F.when(F.col("row") == F.col("first"), name).otherwise(F.concat(F.coalesce(name, F.lit("")), F.lit(":"), F.col("row")))
    rows = rows.select("page_id", "url", "html", "sha", name.alias("name"))
    winners = rows.groupBy("sha").agg(F.max(F.struct("page_id", "name")).alias("w"))
    named = rows.join(winners, "sha").select("name", "url", "html", F.when(F.col("w.name") != F.col("name"), F.col("w.name")).alias("refers_to"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                columns = [c.to_pylist() for c in part.columns[:2]] + [c.to_pylist() for c in (part.column(2).cast(pa.large_binary()), part.column(3))]
                made = [r for page, url, payload, other in zip(*columns, strict=True) for r in page_records(page, url, payload, other)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    out = named.mapInArrow(records, "record binary").select(F.col("record").cast("string"))
    # The separator is the end of a record, so a file is a plain sequence of records.
    out.write.option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


_PARTS = "record_id string, record_type string, refers_to string, url string, digest string, segment int, total long, block binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "record_type", "refers_to", "url", "digest", "segment", "total", "block"]
    kinds = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for content in batch.column(0):
            data = io.BytesIO(content.as_py())
            rows: list[tuple] = []
            for fields, block in parse(gzip.GzipFile(fileobj=data) if data.getbuffer()[:2] == b"\x1f\x8b" else data):
                if fields.get("warc-type") not in ("response", "revisit", "continuation"):
                    continue
                segment, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
                rows.append((origin, fields.get("warc-type"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None, segment and int(segment), total and int(total), block))
                if len(rows) == 128:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for record in batch.to_pylist():
            payload = problem = None
            parts = sorted(record["parts"], key=lambda p: p["segment"] or 1)
            block = b"".join(p["block"] for p in parts)
            total = next((p["total"] for p in parts if p["total"] is not None), None)
            try:
                if [p["segment"] or 1 for p in parts] != list(range(1, len(parts) + 1)):
                    raise ValueError("segments are missing or repeated")
                if total != len(block) if parts[0]["segment"] else len(parts) > 1:
                    raise ValueError("the segments' length differs from the total")
                if record["record_type"] == "response":
                    payload = payload_of(block)
                    if record["digest"] and digest(payload) != record["digest"]:
                        raise ValueError("the payload differs from its digest")
                elif record["record_type"] != "revisit":
                    raise ValueError("the first segment is missing")
            except ValueError as e:
                payload, problem = None, str(e)
            made.append((record["record_id"], record["record_type"], record["refers_to"], record["url"], record["digest"], payload, problem))
        kinds = [pa.string()] * 5 + [pa.binary(), pa.string()]
        columns = zip(*made, strict=True) if made else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["record_id", "record_type", "refers_to", "url", "digest", "payload", "problem"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, record_type, refers_to, url, digest, payload, problem`` for each response and revisit under ``path``.

    Segments of one origin are put together in the order of their numbers, from whatever
    files they lie in; their number and total length are verified, the chunked
    framing is decoded and the payload compared with its digest.  Where one of these fails,
    ``payload`` is null and ``problem`` says why.  A revisit has no payload.  Records of other types (of the
    archive itself, requests, metadata) are passed over.  A file that is not a sequence of records fails the job.  Files are unpacked once,
    record by record; the parts are written in the shared folder.
    """
    parts = written(spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, _PARTS), "parts")
    part = F.struct("segment", "total", "block")
    head = ["record_id", "record_type", "refers_to", "url", "digest"]
    whole = parts.filter("segment IS NULL").select(*head, F.array(part).alias("parts"))
    # Only records in several segments are shuffled.
    first = [F.first(F.when(F.col("segment") == 1, F.col(c)), ignorenulls=True).alias(c) for c in head[1:]]
    cut = parts.filter("segment IS NOT NULL").groupBy("record_id").agg(*first, F.collect_list(part).alias("parts"))
    return whole.union(cut.select(*head, "parts")).mapInArrow(_decode, "record_id string, record_type string, refers_to string, url string, digest string, payload binary, problem string")


def page_listing(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of read records; a revisit has the size of the response it refers to."""
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:x-page:(-?\d*)(:\d+)?>$", 1), F.lit("")).cast("long")
    told = written(records.select("record_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("payload_bytes")), "listing")
    responses = told.filter("record_type = 'response'").select("record_id", page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"))
    revisits = told.filter("record_type = 'revisit'").select(page("record_id").alias("page_id"), F.col("digest").alias("payload_digest"), page("refers_to").alias("refers_to"), F.col("refers_to").alias("record_id"))
    again = revisits.join(responses.select("record_id", "payload_bytes"), "record_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long")).select(columns).union(again.withColumn("record_type", F.lit("revisit")).select(columns))
