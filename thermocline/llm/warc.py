"""WARC archives: captures written as transactions, read back and assembled through concurrent-to identifiers.

write() makes three records of each capture: a request, a response (or a revisit of an equal payload)
and metadata; the first and last name the capture's record in WARC-Concurrent-To. Each record is a
gzip member. Archives are written by Spark's own writer, so any store that Spark reaches will do, and
a lost task's archive never counts. records() reads any such archives, one record a row; captures()
joins requests, responses and metadata into one nested row a capture.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.session import scratch_path, written

CRLF = b"\r\n"
#: Bytes of records that become one row, more or less, and bytes that are unpacked at a time.
PIECE, STEP = 4_000_000, 16_384
#: An empty gzip member: the separator that the text writer puts after each row.
SEPARATOR = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("told_digest", pa.string()), ("block_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])
RECORD_SQL = "record_id string, type string, uri string, date string, concurrent_to array<string>, refers_to string, told_digest string, block_bytes long, payload_bytes long, payload_digest string, fields map<string,string>"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def response_id(sha1: str) -> str:
    """The record that holds a payload: one for each payload, so its name follows from the digest."""
    return f"<urn:uuid:{uuid.UUID(sha1[:32])}>"


def record(kind: str, name: str, headers: list[tuple[str, str | None]], block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member."""
    lines = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: {name}".encode(), f"WARC-Date: {DATE}".encode()]
    lines += [f"{k}: {v}".encode() for k, v in headers if v is not None]
    lines += [b"Content-Length: %d" % len(block), b"", b""]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(CRLF.join(lines)) + packer.compress(block) + packer.compress(CRLF + CRLF) + packer.flush()


def _header(text: str | None) -> str | None:
    """A header's value stays in its line: what would break it is percent-encoded."""
    return None if text is None else "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in text)


def _transactions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (page, uri, payload, sha1 in hex, holds its payload?, alone of its payload?) as pieces of an archive."""
    held: list[bytes] = []
    piece = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["piece"])
    size = 0
    for batch in batches:
        for page, uri, payload, sha1, whole, alone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            digest, kept = "sha1:" + base32(bytes.fromhex(sha1)), response_id(sha1)
            own = kept if whole and alone else f"<urn:uuid:{uuid.uuid4()}>"
            target = ("WARC-Target-URI", _header(uri))
            told = [("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response"), target]
            http = HTTP + b"%d" % len(payload) + CRLF + CRLF
            if whole:
                made = record("response", own, told, http + payload)
            else:
                made = record("revisit", own, [*told, ("WARC-Profile", PROFILE), ("WARC-Refers-To", kept)], http)
            with_it = [target, ("WARC-Concurrent-To", own)]
            asked = record("request", f"<urn:uuid:{uuid.uuid4()}>", [*with_it, ("Content-Type", "application/http;msgtype=request")], b"GET / HTTP/1.1\r\nHost: archive.invalid\r\n\r\n", 1)
            fields = b"" if page is None else b"page_id: %s\r\n" % page.encode()
            about = record("metadata", f"<urn:uuid:{uuid.uuid4()}>", [*with_it, ("Content-Type", "application/warc-fields")], fields, 1)
            held += [asked, made, about]
            size += len(asked) + len(made) + len(about)
            if size > PIECE:
                yield piece()
                held, size = [], 0
    if held:
        yield piece()


def write(pages: DataFrame, page: str = "page_id", uri: str = "url", payload: str = "html", path: str | None = None, least: int = 0) -> str:
    """Writes the archives of pages, a capture a row, and gives their folder.

    Payloads are the text's UTF-8; null is empty. Of rows with equal payloads of at least `least`
    bytes one holds the payload: that of the largest page (null is smallest), of several such rows
    any one; the others are revisits of it. Null ids and addresses stay null, control characters in
    addresses are percent-encoded; an empty table gives archives without records; other columns are
    not read. Payloads are not shuffled, unless more than 200,000 of them have copies: each part of
    the table that Spark reads becomes an archive, so spark.sql.files.maxPartitionBytes sizes them.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload), F.lit(""))
    known = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page).alias("page"), F.col(uri).cast("string").alias("uri"), body.cast("binary").alias("payload"), F.sha1(body.cast("binary")).alias("sha1"))
    # Row numbers must mean the same rows in both passes, so the rows are a table.
    known = written(known.withColumn("bytes", F.octet_length("payload").cast("long")), "payloads")
    last = F.max(F.struct(F.col("page").isNotNull().alias("k"), F.col("page"), F.col("row"))).alias("last")
    copies = known.where(F.col("bytes") >= least).groupBy(F.col("sha1").alias("copy")).agg(last, F.count("*").alias("n")).where("n > 1").select("copy", F.col("last.row").alias("holder"))
    copies = written(copies, "copies")
    few = copies.limit(200_001).count() <= 200_000
    met = known.join(F.broadcast(copies) if few else copies, (F.col("sha1") == F.col("copy")) & (F.col("bytes") >= least), "left")
    whole = F.coalesce(F.col("holder") == F.col("row"), F.lit(True))
    rows = met.select(F.col("page").cast("string").alias("page"), "uri", "payload", "sha1", whole.alias("whole"), (F.col("bytes") >= least).alias("alone"))
    path = path or scratch_path(spark, "warc")
    rows.mapInArrow(_transactions, "piece binary").select(F.col("piece").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).text(path)
    return path


class _Reader:
    """Bytes of concatenated gzip members (or of plain records), in order."""

    def __init__(self, content: bytes):
        self.content, self.at, self.held, self.unpack = memoryview(content), 0, b"", None
        self.plain = content[:2] != b"\x1f\x8b"

    def more(self) -> bool:
        if self.at >= len(self.content):
            return False
        step = self.content[self.at : self.at + STEP]
        if self.plain:
            self.at, self.held = self.at + len(step), self.held + bytes(step)
            return True
        if self.unpack is None:
            self.unpack = zlib.decompressobj(31)
        self.held += self.unpack.decompress(step)
        self.at += len(step)
        if self.unpack.eof:
            self.at, self.unpack = self.at - len(self.unpack.unused_data), None
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while (cut := self.held.find(b"\n")) < 0:
            if not self.more():
                if self.held:
                    raise ValueError("an archive ends within a line")
                return None
        line, self.held = self.held[:cut], self.held[cut + 1 :]
        return line.rstrip(b"\r")

    def take(self, size: int) -> bytes:
        parts, got = [self.held[:size]], min(size, len(self.held))
        self.held = self.held[got:]
        while got < size:
            if not self.more():
                raise ValueError("an archive ends within a record")
            part, self.held = self.held[: size - got], self.held[size - got :]
            parts.append(part)
            got += len(part)
        return b"".join(parts)


def _headers(reader: _Reader) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    name = ""
    while line := reader.line():
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and name:
            found[name][-1] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        found.setdefault(name, []).append(value.strip())
    return found


def parsed(content: bytes) -> Iterator[dict]:
    """The records of an archive; ValueError where it is damaged."""
    reader = _Reader(content)
    while (line := reader.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        head = _headers(reader)
        one = lambda k, head=head: head.get(k, [None])[0]
        length = one("content-length")
        if length is None or not length.isdigit():
            raise ValueError("a record without a length")
        block = reader.take(int(length))
        kind, media = (one("warc-type") or "").lower(), (one("content-type") or "").lower()
        start = 0
        if media.startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            start = cut + 4 if cut >= 0 else len(block)
        payload = memoryview(block)[start:]
        fields = None
        if media.startswith("application/warc-fields"):
            pairs = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x)
            fields = list({k.strip().lower(): v.strip() for k, _, v in pairs}.items())
        told = one("warc-payload-digest")
        yield {
            "record_id": one("warc-record-id"), "type": kind, "uri": one("warc-target-uri"), "date": one("warc-date"), "concurrent_to": head.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"),
            "told_digest": told.rpartition(":")[2] if told else None, "block_bytes": len(block), "payload_bytes": len(payload), "payload_digest": base32(hashlib.sha1(payload).digest()), "fields": fields,
        }


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            held = []
            for found in parsed(content.as_py()):
                held.append(found)
                if len(held) == 2000:
                    yield pa.RecordBatch.from_pylist(held, RECORD)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, RECORD)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder's archives, gzip by record or plain: identifiers, type, digest and size of the payload read.

    One archive is one task's work at a time; a damaged one is an error.
    """
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, RECORD_SQL)


def captures(found: DataFrame) -> DataFrame:
    """One nested row a capture: record_id, type, uri, date, refers_to, told_digest, payload_bytes, payload_digest, request, metadata.

    A capture is a response, revisit or resource record. Requests and metadata belong to it if they name it
    in WARC-Concurrent-To, or if it names them. A capture may lack either (null); of several the one of
    the smallest record id counts, and the fields of the others are lost; requests and metadata of no
    capture have no row. A record id used twice for captures is an error of the archive: the rows meet.
    """
    hub = F.col("type").isin("response", "revisit", "resource")
    kept = ["type", "uri", "date", "refers_to", "told_digest", "payload_bytes", "payload_digest"]
    own = F.struct("record_id", "uri", "date", "payload_bytes", "fields")
    side = found.where(~hub & F.col("type").isin("request", "metadata")).select("record_id", "type", "concurrent_to", own.alias("r"))
    named = side.select(F.explode("concurrent_to").alias("to"), "type", "r")
    calls = found.where(hub & (F.size("concurrent_to") > 0)).select(F.col("record_id").alias("to"), F.explode("concurrent_to").alias("record_id"))
    called = calls.join(side.drop("concurrent_to"), "record_id").select("to", "type", "r")
    least = lambda k: F.min_by(F.when(F.col("type") == k, F.col("r")), F.when(F.col("type") == k, F.col("r.record_id")))
    hubs = found.where(hub).select(F.col("record_id").alias("to"), F.struct(*kept).alias("h"))
    rows = named.unionByName(called).unionByName(hubs, allowMissingColumns=True)
    met = rows.groupBy("to").agg(F.any_value("h", True).alias("h"), least("request").alias("request"), least("metadata").alias("metadata"))
    return met.where(F.col("h").isNotNull()).select(F.col("to").alias("record_id"), "h.*", "request", "metadata")


def assembled(found: DataFrame) -> DataFrame:
    """captures() as a table, each revisit with `held`: the capture that holds its payload, found through WARC-Refers-To.

    Many revisits may refer to one record: their join is followed by nothing that needs them together,
    so that Spark may split it.
    """
    rows = written(captures(written(found, "records")), "captures")  # archives are read once
    holder = rows.where(F.col("type") == "response").select(F.col("record_id").alias("refers_to"), F.struct("record_id", "payload_bytes", "payload_digest", "metadata").alias("held"))
    again = rows.where(F.col("refers_to").isNotNull()).join(holder, "refers_to", "left")
    return rows.where(F.col("refers_to").isNull()).unionByName(again, allowMissingColumns=True)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the pages' archives, written and read back."""
    path = write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    rows = assembled(records(spark, path))
    again, page = F.col("type") == "revisit", lambda c: F.try_element_at(c, F.lit("page_id")).cast("long")
    return rows.select(
        page(F.col("metadata.fields")).alias("page_id"),
        F.when(again, F.col("held.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("told_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(again, page(F.col("held.metadata.fields"))).alias("refers_to"),
    )


ORACLE = r"""
WITH p AS (SELECT row_number() OVER (ORDER BY page_id NULLS FIRST, url) n, page_id, coalesce(html, '') b FROM pages),
d AS (SELECT n, page_id, strlen(b) size, sha1(b) h, max(n) OVER (PARTITION BY sha1(b)) holder FROM p),
y AS (SELECT *, list_transform(range(0, 4), lambda g: list_reduce(list_transform(range(0, 10), lambda k: CAST(instr('0123456789abcdef', h[10 * g + k + 1]) - 1 AS BIGINT)), lambda a, c: a * 16 + c)) forty FROM d)
SELECT y.page_id, CAST(size AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((forty[i // 8 + 1] >> (35 - 5 * (i % 8))) % 32 AS INTEGER) + 1]), '') AS payload_digest, CASE WHEN y.n = y.holder THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN y.n <> y.holder THEN q.page_id END AS refers_to
FROM y JOIN p q ON q.n = y.holder
"""
