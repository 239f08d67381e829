"""WARC archives written and read back: nulls, copies, repeats, long and odd payloads, foreign and damaged archives."""

import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from thermocline.llm import warc

SCHEMA = "page_id long, url string, html string, row int, bytes string, type string"
ODD = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
PAGES = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "same"), (4, "http://a/4", None), (5, "http://a/5", ""), (6, "http://a/ü 6\r\nX: y", ODD), (7, "http://a/7", "long é " * 200_000),
    (8, "u", "\x00\x1f\x8b\x08 odd"), (9, "u", "same page twice"), (9, "v", "same page twice"), (10, "u", "row twice"), (10, "u", "row twice"), (None, "u", "same"), (None, "u", "only null"), (None, None, None),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", "t") for r in rows], SCHEMA)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows):
    """(page, bytes, digest, type, refers to), a row a page."""
    out, done = [], set()
    largest = {}
    for page, _, html in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if page is None else page)
    for page, _, html in rows:
        text, p = html or "", -1 if page is None else page
        first = p == largest[text] and text not in done
        if first:
            done.add(text)
        to = None if first or largest[text] < 0 else largest[text]
        out.append((page, len(text.encode()), digest(text), "response" if first else "revisit", to))
    return sorted(map(str, out))


def read(spark, path):
    rows = warc.assembled(warc.records(spark, path))
    page = lambda c: F.try_element_at(c, F.lit("page_id")).cast("long")
    again = F.col("type") == "revisit"
    got = rows.select(page(F.col("metadata.fields")), F.when(again, F.col("held.payload_bytes")).otherwise(F.col("payload_bytes")), F.when(again, F.col("told_digest")).otherwise(F.col("payload_digest")), "type", F.when(again, page(F.col("held.metadata.fields"))))
    return sorted(str(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("parts", [1, 4])
def test_round_trip(spark, parts):
    path = warc.write(pages(spark, PAGES).repartition(parts))
    assert read(spark, path) == plain(PAGES)
    rows = warc.captures(warc.records(spark, path)).collect()
    assert len(rows) == len(PAGES) and all(r.request is not None and r.metadata is not None for r in rows)
    assert {r.uri for r in rows if r.uri and "6" in r.uri} == {"http://a/ü 6%0D%0AX: y"}


def test_archives_are_gzip_by_record(spark):
    path = warc.write(pages(spark, PAGES))
    whole = b"".join(gzip.open(f).read() for f in glob.glob(path.removeprefix("file:") + "/part*"))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == 3 * len(PAGES)
    assert whole.count(b"WARC-Type: revisit") == sum("revisit" in x for x in plain(PAGES))


def test_many_copies_are_joined_by_a_shuffle(spark):
    rows = [(i, "u", f"text {i % 3}") for i in range(60)] + [(100 + i, "u", f"own {i}") for i in range(20)]
    assert read(spark, warc.write(pages(spark, rows).repartition(3))) == plain(rows)


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "u", "short"), (2, "u", "short"), (3, "u", "a long one"), (4, "u", "a long one"), (4, "u", "short")]
    want = [(p, len(t), digest(t), "revisit" if p == 3 else "response", 4 if p == 3 else None) for p, _, t in rows]
    assert read(spark, warc.write(pages(spark, rows), least=6)) == sorted(map(str, want))


def test_empty_table(spark):
    assert read(spark, warc.write(pages(spark, []))) == []


def foreign(*records):
    return b"".join(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\n{''.join(h + chr(13) + chr(10) for h in heads)}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n" for kind, name, heads, body in records)


def test_foreign_archive(spark, tmp_path):
    """A plain archive whose response names its request, with other records, a folded header and a metadata record of its own."""
    content = foreign(
        ("warcinfo", "<i>", [], b"software: x"),
        ("response", "<r>", ["WARC-Concurrent-To: <q>", "WARC-Target-URI: http://x/\r\n y", "Content-Type: application/http; msgtype=response"], b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhello"),
        ("request", "<q>", ["Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.0\r\n\r\n"),
        ("metadata", "<m>", ["WARC-Concurrent-To: <r>", "Content-Type: application/warc-fields"], b"via: http://y/\r\nhops: L\r\n"),
        ("metadata", "<z>", ["WARC-Concurrent-To: <nowhere>"], b"lost"),
        ("resource", "<s>", [], b"as it is"),
    )
    (tmp_path / "a.warc").write_bytes(content)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(foreign(("resource", "<t>", [], b"x" * 100_000))))
    rows = {r.record_id: r for r in warc.captures(warc.records(spark, str(tmp_path))).collect()}
    assert set(rows) == {"<r>", "<s>", "<t>"}
    assert rows["<r>"].request.record_id == "<q>" and rows["<r>"].metadata.fields == {"via": "http://y/", "hops": "L"}
    assert (rows["<r>"].payload_bytes, rows["<r>"].payload_digest, rows["<r>"].uri) == (5, digest("hello"), "http://x/ y")
    assert rows["<s>"].request is None and rows["<t>"].payload_bytes == 100_000


@pytest.mark.parametrize("content", [b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort", b"no archive\r\n", b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", gzip.compress(b"WARC/1.1\r\nContent-Length: 50\r\n\r\n" + b"y" * 40)[:-12]])
def test_damage_is_an_error(content):
    with pytest.raises(ValueError):
        list(warc.parsed(content))
