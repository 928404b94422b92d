"""WARC archives: write captures as request, response or revisit, and metadata records, read the
archives back, and assemble each transaction into one nested row through WARC-Concurrent-To.

Archives are gzip files written by Spark's own text writer, so they go wherever Spark writes. A
record ends in CRLF CRLF; the writer's newline is the last of these four bytes. Readers stream one
(unsplittable) file after another in pieces that end in CRLF CRLF and cut records by Content-Length,
so payloads may hold any bytes, WARC headers among them, and no file is held in memory.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, load, scratch_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS = "record_id string, record_type string, concurrent_to string, target_uri string, date string, digest string, fields map<string,string>, body_bytes long, body binary"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(binary: Column) -> Column:
    """SHA-1 in base32 without prefix: 160 bits are eight groups of 20 bits, four letters each."""
    digits = F.sha1(binary)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record(kind: str, record_id: Column, headers: list[Column], block: Column) -> Column:
    """Text of a record up to the CR of its last CRLF."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:"), record_id, F.lit(">\r\n"), *headers]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the captures (page_id, url, html) as WARC archives below path.

    Of captures with equal payloads of at least min_bytes bytes, those with the smallest page_id are
    responses and the others revisit them; a smaller payload is always a response. A null html is an
    empty payload, a null url an empty one. A null page_id is never smallest unless all are null.
    Repeated rows are captures of their own. Further columns of pages are ignored.
    """
    made = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    first = (
        made.where(F.col("bytes") >= min_bytes)
        .groupBy("digest", "bytes")
        .agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    joined = made.join(first, ["digest", "bytes"], "left").withColumns(
        {
            "revisit": F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")),
            "capture": F.expr("uuid()"),
        }
    )
    crlf = F.lit("\r\n")
    uri = F.concat(F.lit("WARC-Target-URI: "), "url", crlf)
    when = F.lit(f"WARC-Date: {date}\r\n")
    to = F.concat(F.lit("WARC-Concurrent-To: <urn:uuid:"), "capture", F.lit(">\r\n"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest", crlf)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    msg = F.lit("Content-Type: application/http; msgtype=response\r\n")
    response = _record("response", F.col("capture"), [when, uri, digest, msg], F.concat(http, "html"))
    revisit = _record(
        "revisit",
        F.col("capture"),
        [when, uri, digest, F.lit(f"WARC-Profile: {PROFILE}\r\n"), F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.coalesce("first_url", F.lit("")), crlf), F.lit(f"WARC-Refers-To-Date: {date}\r\n"), msg],
        http,
    )
    request = _record(
        "request", F.expr("uuid()"), [when, uri, to, F.lit("Content-Type: application/http; msgtype=request\r\n")], F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1\r\nUser-Agent: meridian\r\n\r\n"))
    )
    notes = F.concat(
        F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), crlf), F.lit("")),
        F.lit("payloadBytes: "),
        F.col("bytes").cast("string"),
        crlf,
        F.when(F.col("revisit"), F.concat(F.lit("refersToPage: "), F.col("first_id").cast("string"), crlf)).otherwise(F.lit("")),
    )
    metadata = _record("metadata", F.expr("uuid()"), [when, uri, to, F.lit("Content-Type: application/warc-fields\r\n")], notes)
    text = F.concat(request, F.lit("\n"), F.when(F.col("revisit"), revisit).otherwise(response), F.lit("\n"), metadata)
    joined.select(text.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", 20_000).text(path)


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode().lower()] = value.strip().decode("utf-8", "replace")
    return out


class _Reader:
    """Takes archives piece by piece, in order, and yields the records they complete."""

    def __init__(self) -> None:
        self.held = bytearray()
        self.header: dict[str, str] | None = None

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += piece + END
        while True:
            if self.header is None:
                while self.held[:1] in (b"\r", b"\n"):  # what is left of END where a body ended in a part of it
                    del self.held[:1]
                if (at := self.held.find(END)) < 0:
                    return
                if not self.held.startswith(b"WARC/"):
                    raise ValueError(f"not a WARC record: {bytes(self.held[:80])!r}")
                self.header = _headers(bytes(self.held[:at]))
                del self.held[: at + len(END)]
            size = int(self.header["content-length"])
            if len(self.held) < size + len(END):
                return
            if self.held[size : size + len(END)] != END:
                raise ValueError(f"record {self.header.get('warc-record-id')} is longer than its Content-Length")
            out = self.header, bytes(self.held[:size])
            del self.held[: size + len(END)]
            self.header = None
            yield out


def _parsed(header: dict[str, str], block: bytes, keep_body: bool) -> tuple:
    kind, body, fields = header.get("warc-type", ""), block, {}
    if header.get("content-type", "").startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        fields = _headers(head)
    elif header.get("content-type") == "application/warc-fields":
        fields = _headers(block)
    digest = header.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response" and digest:
        found = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if found != digest:
            raise ValueError(f"record {header.get('warc-record-id')}: payload digest {found}, header {digest}")
    return (header.get("warc-record-id"), kind, header.get("warc-concurrent-to"), header.get("warc-target-uri"), header.get("warc-date"), digest, fields, len(body), body if keep_body else None)


def read_archives(spark: SparkSession, path: str, keep_body: bool = True) -> DataFrame:
    """One row for each record of the archives below path; broken records raise an error.

    body is the HTTP body (or the block of other records), null where keep_body is false.
    An archive without records gives no rows.
    """
    columns = [c.split(" ")[0] for c in RECORDS.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader()
        for batch in batches:
            rows, held = [], 0
            for piece in batch["value"]:
                for found in reader.feed(bytes(piece)):
                    rows.append(_parsed(*found, keep_body))
                    held += len(found[1]) if keep_body else 0
                if held > 16_000_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)
        if reader.header is not None or reader.held:
            raise ValueError("an archive ends within a record")

    pieces = spark.read.schema("value string").option("lineSep", END.decode()).text(path)
    return pieces.select(F.col("value").cast("binary").alias("value")).mapInPandas(parse, RECORDS)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit record, and the request and metadata
    records that name it in WARC-Concurrent-To (no such: empty arrays; several: in the order of
    their ids). The join is one grouping by the capture's id, so archives are read once. Records
    that belong to no capture are left out; captures of one id share their other records."""
    part = F.struct(*[c for c in records.columns if c not in ("record_type", "concurrent_to")])
    main = F.col("record_type").isin("response", "revisit")
    other = lambda kind: F.when(F.col("record_type") == kind, F.struct("record_id", "target_uri", "date", F.map_entries("fields").alias("fields")))
    key = F.when(main, F.col("record_id")).when(F.col("record_type").isin("request", "metadata"), F.col("concurrent_to"))
    grouped = (
        records.withColumn("capture_id", key)
        .where("capture_id IS NOT NULL")
        .groupBy("capture_id")
        .agg(F.collect_list(F.when(main, F.struct("record_type", part.alias("response")))).alias("main"), *[F.sort_array(F.collect_list(other(kind))).alias(f"{kind}s") for kind in ("request", "metadata")])
    )
    return grouped.select("capture_id", F.inline("main"), "requests", "metadatas")


def _note(name: str) -> Column:
    entry = F.filter(F.get(F.col("metadatas"), F.lit(0))["fields"], lambda e: e["key"] == name)
    return F.try_element_at(entry, F.lit(1))["value"].cast("long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(load(spark, sf_dir, "pages"), path, min_bytes=0)
    captures = assemble_transactions(read_archives(spark, path, keep_body=False))
    return captures.select(
        _note("pageid").alias("page_id"),
        F.when(F.col("record_type") == "response", F.col("response.body_bytes")).otherwise(_note("payloadbytes")).alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        "record_type",
        _note("referstopage").alias("refers_to"),
    )


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
         array_to_string(list_transform(range(0, 8), lambda i:
           array_to_string(list_transform([15, 10, 5, 0], lambda s:
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * i::INT + 1, 5))::INT >> s) & 31), 1)), '')), '') AS payload_digest
  FROM p
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM m
"""
