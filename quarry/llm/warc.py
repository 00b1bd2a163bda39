"""WARC: write captures as archives, read them back, assemble transactions.

Writing is declarative: each capture becomes a request record, a response or revisit record, and a metadata record;
their text is built by column expressions and stored by the text sink, gzip-compressed, with the blank lines that end a
record as line separator. Of captures with equal payloads the one with the smallest key is the response, the others revisit
it (profile identical-payload-digest). Reading cuts records by Content-Length, so payloads may hold
anything. Assembly joins the request and metadata records to their response or revisit through
WARC-Concurrent-To, and emits one nested row per capture.

Scale: digests are counted as narrow rows; payloads are read twice and stay where they are, unless more than ``BROADCAST_ROWS`` rows repeat others; then they
are shuffled by row number, never by digest, so a payload that a third of all pages share gathers nowhere. Files are bounded in captures and, by
their mean size, in bytes; they are read as streams, so what a task holds is one record. Record ids are derived
from the key, so a retried task writes the same ids. Archives are parsed once: records leave that pass without payloads, unless those are asked for.

Cases: a null payload is empty; a null key sorts after all others; empty payloads are equal payloads, unless ``min_bytes``
is above 0; of repeated rows (same key, same payload) the first is the response and the others revisit it; a null URL is
written as ``about:blank``; very long payloads are kept whole; line breaks in a URL are percent-encoded; an empty table writes no record and reads back as no row;
other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise, read_table, salted_join, scratch_dir

RECORDS_PER_FILE = 50_000
BYTES_PER_FILE = 128 << 20
LINE = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: alphabet of base32
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

RECORD_SCHEMA = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, page_id long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(payload: F.Column) -> F.Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    return F.concat(*(F.translate(F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0"), DIGITS32, BASE32) for k in range(8)))


def _record_id(kind: str, *of: F.Column) -> F.Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *of))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, F.Column]], block: F.Column) -> F.Column:
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in headers:  # a null value leaves the header out
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n")))
    return F.concat(*lines, block)


def captured(pages: DataFrame) -> DataFrame:
    """page_id, row_no, url and payload of every row of ``pages``; to be written, as numbers depend on how the table is split."""
    text = lambda name, absent: F.coalesce(F.col(name).cast("string"), F.lit(absent))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row_no"), text("url", "about:blank").alias("url"), text("html", "").alias("payload"),
    )


def revisits(digests: DataFrame, min_bytes: int = 0) -> DataFrame:
    """row_no and the (first_page, first_row) that it refers to, of every row that repeats a payload of ``min_bytes`` or more."""
    # struct order puts a null first, so a flag sorts null keys last
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row_no")).alias("first")
    long = digests.where(F.col("size") >= min_bytes)
    groups = long.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.col("first.page_id").alias("first_page"), F.col("first.row_no").alias("first_row"))
    return salted_join(long, groups, "digest", "row_no").where("row_no <> first_row").select("row_no", "first_page", "first_row")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE, bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Write the captures of ``pages`` (page_id, url, html) as gzip-compressed WARC files under ``path``.

    A file holds at most ``records_per_file`` captures, and fewer where their mean size would take it beyond ``bytes_per_file``.
    """
    pages = materialise(captured(pages))
    digests = materialise(pages.select("page_id", "row_no", base32_sha1(F.encode("payload", "UTF-8")).alias("digest"), F.octet_length("payload").cast("long").alias("size")))
    mean = digests.agg(F.avg("size")).first()[0] or 0
    records_per_file = max(1, min(records_per_file, int(bytes_per_file / (mean + 1000))))
    again = materialise(revisits(digests, min_bytes))
    # the rows that repeat are few numbers each; payloads meet them where they are, unless there are too many
    hint = F.broadcast if again.count() <= BROADCAST_ROWS else lambda x: x
    rows = pages.join(hint(again), "row_no", "left").withColumn("revisit", F.col("first_row").isNotNull())
    rows = rows.withColumn("digest", base32_sha1(F.encode("payload", "UTF-8")))
    key = [F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("row_no").cast("string")]
    first = [F.coalesce(F.col("first_page").cast("string"), F.lit("")), F.col("first_row").cast("string")]
    own = _record_id("response", *key)
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    host = F.coalesce(F.nullif(F.regexp_extract(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")), F.lit("localhost"))
    target = F.coalesce(F.nullif(F.regexp_extract(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    kind = F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    date = F.lit(DATE)
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _record_id("request", *key)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")),
    )
    response = _record(
        [
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Refers-To", F.when(F.col("revisit"), _record_id("response", *first))),
            ("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload"))),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _record_id("metadata", *key)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")),
    )
    end = "\r\n\r\n"
    rows.select(F.concat(request, F.lit(end), response, F.lit(end), metadata).alias("value")).write.options(
        lineSep=end, compression="gzip", maxRecordsPerFile=records_per_file
    ).text(path)


def _fields(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n"):
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def parse_records(lines: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of (file, line) pairs, the lines of a file in order, cut at every CR LF.

    A block ends where Content-Length says, whatever it holds; no more than one record is held.
    """
    fields, head, block, size, place = None, [], [], 0, None

    def cut_off() -> ValueError:
        return ValueError(f"record {(fields or {}).get('warc-record-id')} of {place} is cut off")

    for file, line in lines:
        if file != place:
            if fields is not None or head:
                raise cut_off()
            place = file
        if fields is None:
            if head and not line:
                fields = _fields(b"\r\n".join(head[1:]))
                head, block, size = [], [], -2  # the first line of a block has no CR LF before it
            elif line:
                if not head and not line.startswith(b"WARC/"):
                    raise ValueError(f"not the start of a WARC record: {line[:60]!r}")
                head.append(line)
            continue
        block.append(line)
        size += len(line) + 2
        wanted = int(fields["content-length"])
        if size >= wanted:
            whole = b"\r\n".join(block)
            if len(whole) > wanted and whole[wanted:].strip():
                raise ValueError(f"record {fields.get('warc-record-id')} of {place} is longer than it says")
            yield fields, whole[:wanted]
            fields = None
    if fields is not None or head:
        raise cut_off()


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record; size and digest are those of the full payload, for a revisit as its headers tell.

    Spark's text source unpacks and streams the files, in one gzip member or many; a task sees the lines of each of its files in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 9
            rows.clear()
            kinds = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RECORD_SCHEMA.split(", ")])

        lines = ((file, line) for batch in batches for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for fields, block in parse_records(lines):
            kind, page, size, digest, payload = fields["warc-type"], None, None, None, None
            if kind in ("response", "revisit"):
                head, _, payload = block.partition(b"\r\n\r\n")
                if kind == "response":
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                else:
                    size, digest, payload = int(_fields(head)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), None
            elif kind == "metadata":
                number = _fields(block).get("page-id", "")
                page = int(number) if number else None
            rows.append((fields["warc-record-id"], kind, fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), page, size, digest, payload if payloads else None))
            held += len(payload or b"") if payloads else 0
            if len(rows) >= 10_000 or held > 16 << 20:
                yield flush()
                held = 0
        yield flush()

    text = spark.read.option("lineSep", LINE).option("pathGlobFilter", "*.gz").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line")).mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, with its request and its metadata where they exist."""
    capture = records.where(F.col("record_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), "record_type", "refers_to", "target_uri", "payload_bytes", "payload_digest", "payload"
    )
    def part(kind: str) -> DataFrame:
        mine = records.where(F.col("record_type") == kind)
        return mine.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min(F.struct("record_id", "target_uri", "page_id")).alias(kind))

    return capture.join(part("request"), "capture_id", "left").join(part("metadata"), "capture_id", "left")


def captures(transactions: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the response's page_id) of assembled transactions."""
    rows = transactions.select("capture_id", F.col("metadata.page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").alias("target"))
    seen = rows.where("target is not null").select(F.col("target").alias("capture_id")).distinct()
    targets = rows.where("record_type = 'response'").select("capture_id", "page_id").join(seen, "capture_id", "left_semi").toDF("target", "refers_to")
    # responses refer to nothing; revisits of one response are dealt to several tasks
    plain = rows.where("target is null").withColumn("refers_to", F.lit(None).cast("long"))
    told = salted_join(rows.where("target is not null"), targets, "target", "capture_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return plain.select(columns).unionByName(told.select(columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    write_archives(read_table(spark, sf_dir, "pages"), path)
    return captures(assemble(materialise(read_archives(spark, path).drop("payload")).withColumn("payload", F.lit(None).cast("binary"))))


ORACLE = rf"""
WITH d AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT page_id, octet_length(payload) AS payload_bytes,
    array_to_string(list_transform(range(8), lambda k: (
      array_to_string(list_transform(range(4), lambda j:
        substr('{BASE32}', CAST(((('0x' || substr(h, CAST(k * 5 + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * j AS BIGINT)) & 31) + 1 AS BIGINT), 1)), ''))), '') AS payload_digest
  FROM d
), g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM b)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_page THEN NULL ELSE first_page END AS refers_to
FROM g
"""
