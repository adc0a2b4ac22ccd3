"""Web archives: writing captures as WARC records, reading records, and assembling them into one nested row per capture.

Archives are written by Spark's text writer, whose line separator is the blank line pair that ends a record, so any file
system that Spark reaches will do. Reading goes by ``Content-Length``; payloads may hold anything, separators included.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomosaic.llm.common import Workspace

# fixed values of the format
VERSION = b"WARC/"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CAPTURED = ("response", "revisit", "resource")
#: Captures in one archive file at most, so that a file fits into a task's memory when read.
CAPTURES_PER_FILE = 20_000
#: Records, and bytes of their payloads, that the reader hands over at once.
RECORDS_AT_ONCE, BYTES_AT_ONCE = 512, 16 << 20

RECORD = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
    "stated_digest string, payload_bytes bigint, payload_digest string, payload binary, fields string"
)


# --- writing ---------------------------------------------------------------------------------------------------------


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8 bytes: eight groups of 20 bits, four letters each."""
    hexed = F.sha1(payload.cast("binary"))
    groups = [F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    letters = [F.substring(F.lit(BASE32), F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def record_id(kind: str, *parts: Column) -> Column:
    """A name-based id, the same whenever the job runs again."""
    name = F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    h = F.md5(name.cast("binary"))
    return F.concat(
        F.lit("<urn:uuid:"),
        F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
        F.lit(">"),
    )


def record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two line ends behind it. Null headers are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), *lines, length)
    return F.concat(head, F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """A request, a response or revisit, and a metadata record for each row of ``pages`` (page_id, url, html).

    Of equal payloads of at least ``least_bytes`` bytes, the row with the largest page_id is the response and the others
    revisit it (null ids are smallest; several rows with that id are all responses). A null html is an empty payload, a
    null url leaves the target out, a null page_id leaves the metadata empty. Rows that agree in id, url and html get the
    same record ids: the archive names them as one capture.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    read = pages.select("page_id", "url", html.alias("html")).withColumns(
        {"digest": base32_sha1(F.col("html")), "bytes": F.octet_length("html").cast("long")}
    )
    # one row for each payload: combined before the shuffle, however often it is copied
    first = (
        read.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    ).filter("n > 1").drop("n")
    rows = read.join(first, "digest", "left")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))

    own = [F.col("page_id"), F.col("url"), F.col("digest")]
    answer = record_id("response", *own)
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", target)]
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2)
    )
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    says = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = record("response", [("WARC-Record-ID", answer), *common, digest, says], F.concat(http, "html"))
    revisit = record(
        "revisit",
        [
            ("WARC-Record-ID", answer),
            *common,
            digest,
            ("WARC-Refers-To", record_id("response", F.col("first.page_id"), F.col("first.url"), F.col("digest"))),
            ("WARC-Profile", F.lit(PROFILE)),
            says,
        ],
        http,
    )
    path = F.coalesce(F.regexp_extract(target, "(?s)^.*?://[^/]*(/.*)$", 1), F.lit(""))
    request = record(
        "request",
        [
            ("WARC-Record-ID", record_id("request", *own)),
            *common,
            ("WARC-Concurrent-To", answer),
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
    )
    metadata = record(
        "metadata",
        [
            ("WARC-Record-ID", record_id("metadata", *own)),
            *common,
            ("WARC-Concurrent-To", answer),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")),
    )
    lines = rows.select(F.concat_ws(CRLF * 2, request, F.when(revisits, revisit).otherwise(response), metadata).alias("value"))
    lines.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", CAPTURES_PER_FILE).text(folder)


# --- reading ---------------------------------------------------------------------------------------------------------


class Inflated(io.RawIOBase):
    """The plain bytes of a file that may be gzip members one after another; nothing is unpacked before it is read."""

    def __init__(self, content: bytes):
        self.content, self.at, self.ready = memoryview(content), 0, b""
        self.packed = content[:2] == b"\x1f\x8b"
        self.member = None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.ready and self.at < len(self.content):
            piece = self.content[self.at : self.at + (1 << 16)]
            if not self.packed:
                self.ready = bytes(piece)
                self.at += len(piece)
                break
            self.member = self.member or zlib.decompressobj(31)
            self.ready = self.member.decompress(piece)
            self.at += len(piece) - len(self.member.unused_data)
            if self.member.eof:
                self.member = None
        n = min(len(buffer), len(self.ready))
        buffer[:n] = self.ready[:n]
        self.ready = self.ready[n:]
        return n


def records(content: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers by lower-case name, block) of each record of an archive file."""
    stream = io.BufferedReader(Inflated(content), 1 << 20)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(VERSION):
            raise ValueError(f"a record begins with {line[:40]!r}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(headers["content-length"][0])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"a record of {size} bytes ends after {len(block)}")
        yield headers, block


def row_of(headers: dict[str, list[str]], block: bytes, payloads: bool) -> dict[str, object]:
    def one(name: str) -> str | None:
        return headers.get(name, [None])[0]

    kind = one("warc-type")
    payload = block
    if (one("content-type") or "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    whole = kind in ("response", "resource")
    return {
        "record_id": one("warc-record-id") or "sha1:" + hashlib.sha1(repr(headers).encode() + block).hexdigest(),
        "type": kind,
        "target_uri": one("warc-target-uri"),
        "date": one("warc-date"),
        "concurrent_to": headers.get("warc-concurrent-to", []),
        "refers_to": one("warc-refers-to"),
        "stated_digest": (one("warc-payload-digest") or "").removeprefix("sha1:") or None,
        "payload_bytes": len(payload) if whole else None,
        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else None,
        "payload": payload if whole and payloads else None,
        "fields": block.decode("utf-8", "replace") if kind == "metadata" else None,
    }


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the archives in a folder, plain or gzip (one member or many). Files without records give no rows.

    A record without an id gets one made from its content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for headers, block in records(content.as_py()):
                    rows.append(row_of(headers, block, payloads))
                    size += len(block) if payloads else 0
                    if len(rows) >= RECORDS_AT_ONCE or size >= BYTES_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, RECORD)


RECORD_ARROW = pa.schema(
    [
        *[(n, pa.string()) for n in ("record_id", "type", "target_uri", "date")],
        ("concurrent_to", pa.list_(pa.string())),
        *[(n, pa.string()) for n in ("refers_to", "stated_digest")],
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
        ("fields", pa.string()),
    ]
)


# --- assembly --------------------------------------------------------------------------------------------------------


def assemble(archive: DataFrame) -> DataFrame:
    """One row per capture: (capture_id, capture, requests, metadata), joined through concurrent-to ids of either direction.

    ``capture`` is the response, revisit or resource record; ``requests`` and ``metadata`` are arrays by record id. Records
    with the same id are one record. A link may go through one other record (metadata of a request). Requests and metadata
    that reach no capture give a row of their own with a null ``capture``, under the id that they share or their own. Rows
    with a null record_id are taken as one record; the reader gives none.
    """
    links = archive.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b")).filter("a IS NOT NULL")
    both = links.union(links.select("b", "a")).distinct()
    heads = archive.filter(F.col("type").isin(*CAPTURED)).select(F.col("record_id").alias("head")).distinct()
    near = both.join(heads, both["b"] == heads["head"]).groupBy("a").agg(F.min("head").alias("head"))
    far = both.join(near.select(F.col("a").alias("b"), "head"), "b").groupBy("a").agg(F.min("head").alias("far_head"))
    loose = links.groupBy("a").agg(F.min("b").alias("named"))
    placed = (
        archive.alias("r")
        .join(near.withColumnRenamed("a", "record_id"), "record_id", "left")
        .join(far.withColumnRenamed("a", "record_id"), "record_id", "left")
        .join(loose.withColumnRenamed("a", "record_id"), "record_id", "left")
    )
    key = F.when(F.col("type").isin(*CAPTURED), F.col("record_id")).otherwise(F.coalesce("head", "far_head", "named", "record_id"))
    names = archive.columns
    item = F.struct(*[F.col(n) for n in names])
    grouped = placed.withColumn("capture_id", key).groupBy("capture_id", "record_id", "type").agg(F.first(item).alias("item"))

    def those(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.col("item"))), lambda x, y: F.when(x["record_id"] < y["record_id"], -1).when(x["record_id"] > y["record_id"], 1).otherwise(0))

    return grouped.groupBy("capture_id").agg(
        F.first(F.when(F.col("type").isin(*CAPTURED), F.col("item")), ignorenulls=True).alias("capture"),
        those("request").alias("requests"),
        those("metadata").alias("metadata"),
    )


def payload_table(captures: DataFrame, ws: Workspace) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of captures that ``write_archives`` wrote.

    A revisit has the length of the response that it refers to, and that page's id; its digest is the stated one.
    """
    fields = F.element_at("metadata", 1)["fields"]
    page = F.regexp_extract(F.coalesce(fields, F.lit("")), r"page-id: (-?\d+)", 1)
    rows = ws.keep(
        captures.filter("capture IS NOT NULL").select(
            "capture_id",
            F.when(page != "", page).cast("long").alias("page_id"),
            F.col("capture.type").alias("record_type"),
            F.col("capture.refers_to").alias("refers_id"),
            F.col("capture.payload_bytes").alias("bytes"),
            F.coalesce("capture.payload_digest", "capture.stated_digest").alias("payload_digest"),
        ),
        "captures",
    )
    told = rows.filter("record_type = 'response'").select(
        F.col("capture_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("told_bytes")
    )
    return rows.join(told, "refers_id", "left").select(
        "page_id", F.coalesce("bytes", "told_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
