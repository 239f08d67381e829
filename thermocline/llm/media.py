"""Media columns as ISO base media files: a muxer and a box walker that decodes sample tables only.

The muxer stores bytes as an 8-bit raw audio track: fixed-size access units, grouped into chunks,
every few units a sync unit. The walker reads nested boxes of any such file (32-bit, 64-bit and
to-the-end sizes), decodes the sample tables (stsd, mdhd, stts, stsc, stsz/stz2, stco/co64, stss) and
the runs of fragments (trex, tfhd, trun), and gives every track's codec, duration and keyframe byte
ranges without touching the payload. A count that the file's bytes cannot hold is damage.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

UNIT, PER_CHUNK, SYNC_EVERY, RATE = 64, 16, 16, 8000
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def table(kind: bytes, rows: list[tuple], *head: int) -> bytes:
    packed = b"".join(struct.pack(f">{len(r)}I", *r) for r in rows)
    return full(kind, struct.pack(f">{len(head) + 1}I", *head, len(rows)), packed)


def mux(payload: bytes) -> bytes:
    """An ISO media file that holds payload (a positive multiple of UNIT bytes) as 8-bit samples."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of the unit")
    units = len(payload) // UNIT
    chunks = -(-units // PER_CHUNK)
    ticks = units * UNIT
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
    runs = [(1, min(PER_CHUNK, units), 1)]
    if chunks > 1 and units % PER_CHUNK:
        runs.append((chunks, units % PER_CHUNK, 1))

    def moov(first: int) -> bytes:
        stbl = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), table(b"stts", [(units, UNIT)]), table(b"stsc", runs), full(b"stsz", struct.pack(">II", UNIT, units)),
            table(b"stco", [(first + k * PER_CHUNK * UNIT,) for k in range(chunks)]), table(b"stss", [(k + 1,) for k in range(0, units, SYNC_EVERY)]),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, ticks, 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, ticks, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    start = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    head = start + moov(0)
    if len(payload) + len(head) + 8 > 0xFFFFFFFF:
        raise ValueError("one file holds less than 4 GiB")
    return start + moov(len(head) + 8) + box(b"mdat", payload)


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of the body, end) of the boxes between at and end."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} at {at} has a bad size")
        yield kind, body, at + size
        at += size


@dataclass
class Track:
    number: int = 0
    codec: str = ""
    kind: str = ""
    timescale: int = 0
    duration: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)  # byte range of each sample
    keys: list[int] = field(default_factory=list)  # numbers of the sync samples, from 0

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0


def walk(content: bytes) -> list[Track]:
    """The tracks of a file; raises ValueError where it is damaged."""
    data, tracks = memoryview(content), []

    def numbers(at: int, n: int, end: int, kind: str = "I") -> tuple[int, ...]:
        if at + n * struct.calcsize(">" + kind) > end:
            raise ValueError("a table is longer than its box")
        return struct.unpack_from(f">{n}{kind}", data, at)

    defaults: dict[int, tuple[int, ...]] = {}  # of fragments by track: description, duration, size, flags

    def visit(at: int, end: int, found: dict, depth: int) -> None:
        begin = at
        for kind, body, stop in boxes(data, at, end):
            if kind == b"trak":
                inner: dict = {}
                visit(body, stop, inner, depth + 1)
                tracks.append(track(inner))
            elif kind == b"trex":
                number, *rest = numbers(body + 4, 5, stop)
                defaults[number] = tuple(rest)
            elif kind == b"moof":
                fragment(begin, body, stop)
            elif kind in CONTAINERS and depth < 16:
                visit(body, stop, found, depth + 1)
            else:
                found[kind] = (body, stop)
            begin = stop

    def fragment(start: int, at: int, end: int) -> None:
        """The samples of a movie fragment that begins at `start`, added to their tracks."""
        after = start
        for kind, body, stop in boxes(data, at, end):
            if kind != b"traf":
                continue
            own, runs = None, []
            for inner, first, last in boxes(data, body, stop):
                if inner == b"tfhd":
                    own = (first, last)
                elif inner == b"trun":
                    runs.append((first, last))
            if own is None:
                raise ValueError("a fragment without a header")
            (flags, number), place = numbers(own[0], 2, own[1]), own[0] + 8
            flags &= 0xFFFFFF
            one = next((t for t in tracks if t.number == number), None)
            if one is None:
                raise ValueError(f"a fragment of the unknown track {number}")
            base = start if flags & 0x20000 else after
            if flags & 1:
                base, place = numbers(place, 1, own[1], "Q")[0], place + 8
            usual = dict(zip(("description", "duration", "size", "flags"), defaults.get(number, (1, 0, 0, 0)), strict=True))
            for bit, name in ((2, "description"), (8, "duration"), (16, "size"), (32, "flags")):
                if flags & bit:
                    usual[name], place = numbers(place, 1, own[1])[0], place + 4
            position = base
            for first, last in runs:
                (how, n), place = numbers(first, 2, last), first + 8
                if n > len(data):
                    raise ValueError("more samples than bytes")
                if how & 1:
                    position, place = base + numbers(place, 1, last, "i")[0], place + 4
                opening = None
                if how & 4:
                    opening, place = numbers(place, 1, last)[0], place + 4
                given = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if how & bit]
                flat = numbers(place, n * len(given), last)
                for k in range(n):
                    sample = usual | dict(zip(given, flat[k * len(given) : (k + 1) * len(given)], strict=True))
                    if k == 0 and opening is not None:
                        sample["flags"] = opening
                    if not sample["flags"] & 0x10000:
                        one.keys.append(len(one.spans))
                    one.spans.append((position, sample["size"]))
                    one.duration += sample["duration"]
                    position += sample["size"]
                after = position

    def rows(found: dict, kind: bytes, width: int, at: int = 4) -> list[tuple[int, ...]]:
        if kind not in found:
            return []
        body, end = found[kind]
        (n,) = numbers(body + at, 1, end)
        flat = numbers(body + at + 4, n * width, end)
        return [flat[k * width : (k + 1) * width] for k in range(n)]

    def track(found: dict) -> Track:
        out = Track()
        if b"tkhd" in found:
            body, end = found[b"tkhd"]
            out.number = numbers(body + (20 if data[body] else 12), 1, end)[0]
        if b"mdhd" in found:
            body, end = found[b"mdhd"]
            if data[body]:
                out.timescale, out.duration = numbers(body + 20, 1, end)[0], numbers(body + 24, 1, end, "Q")[0]
            else:
                out.timescale, out.duration = numbers(body + 12, 2, end)
        if b"hdlr" in found:
            out.kind = bytes(data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12]).decode("latin-1")
        if b"stsd" in found:
            out.codec = bytes(data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16]).decode("latin-1").strip()
        sizes: list[int] = []
        if b"stsz" in found:
            body, end = found[b"stsz"]
            each, n = numbers(body + 4, 2, end)
            if n > len(data):
                raise ValueError("more samples than bytes")
            sizes = [each] * n if each else list(numbers(body + 12, n, end))
        elif b"stz2" in found:
            body, end = found[b"stz2"]
            width, (n,) = data[body + 7], numbers(body + 8, 1, end)
            if width == 4:
                sizes = [x for pair in numbers(body + 12, -(-n // 2), end, "B") for x in (pair >> 4, pair & 15)][:n]
            elif width in (8, 16):
                sizes = list(numbers(body + 12, n, end, "B" if width == 8 else "H"))
            else:
                raise ValueError(f"sample sizes of {width} bits")
        offsets = [x for (x,) in rows(found, b"stco", 1)]
        if b"co64" in found:
            body, end = found[b"co64"]
            offsets = list(numbers(body + 8, numbers(body + 4, 1, end)[0], end, "Q"))
        runs, sample = rows(found, b"stsc", 3), 0
        for k, (first, count, _) in enumerate(runs):
            last = runs[k + 1][0] - 1 if k + 1 < len(runs) else len(offsets)
            for chunk in range(first - 1, last):
                at = offsets[chunk]
                for size in sizes[sample : sample + count]:
                    out.spans.append((at, size))
                    at += size
                sample += count
        ticks = sum(n * d for n, d in rows(found, b"stts", 2))
        out.duration = ticks or out.duration
        out.keys = [x - 1 for (x,) in rows(found, b"stss", 1)] if b"stss" in found else list(range(len(out.spans)))
        return out

    try:
        visit(0, len(data), {}, 0)
    except (struct.error, IndexError) as e:
        raise ValueError(f"damaged file: {e}") from e
    return tracks


def read_back(content: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The samples' bytes, neighbouring ranges taken at once."""
    out, k = [], 0
    while k < len(spans):
        at, size = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] == at + size:
            size += spans[k][1]
            k += 1
        out.append(content[at : at + size])
    return b"".join(out)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


def media_column(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """documents' ids with their texts as media files: doc_id, n_bytes, media (binary).

    A null text is an empty one; an empty payload is one unit of zeros.
    """
    base = documents.select(documents[doc].alias("doc_id"), documents[text].alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made = [padded(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([mux(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return base.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


FEATURES = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, n_samples long, keyframes array<struct<offset: long, size: long>>, tracks array<struct<codec: string, kind: string, duration_s: double, n_samples: long, keyframes: array<struct<offset: long, size: long>>>>, error string"
)


def describe(media: DataFrame, column: str = "media") -> DataFrame:
    """Features of each file of a binary column, beside the other columns (which must not clash).

    `tracks` has an entry for every track; the other columns are of the first one, and the payload is
    what its sample ranges hold. Null, empty and damaged files have null features and say so in
    `error`; files without a track, and samples beyond the end of the file, are damage.
    """
    rest = [x for x in media.columns if x != column]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != column)
    schema = (kinds + ", " if kinds else "") + FEATURES

    def features(content: bytes | None) -> dict:
        if content is None:
            return {"error": "null"}
        try:
            tracks = walk(content)
            if not tracks:
                raise ValueError("no track")
            one = tracks[0]
            if any(a + n > len(content) for t in tracks for a, n in t.spans):
                raise ValueError("samples beyond the end")
            payload = read_back(content, one.spans)
        except ValueError as e:
            return {"error": str(e)}
        frames = lambda t: [t.spans[k] for k in t.keys if 0 <= k < len(t.spans)]
        listed = lambda t: [{"offset": a, "size": n} for a, n in frames(t)]
        keys = frames(one)
        said = f"{one.codec};{one.kind};{one.duration}/{one.timescale};{len(one.spans)};" + ",".join(f"{a}+{n}" for a, n in keys)
        return {
            "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(content), "media_sha256": hashlib.sha256(content).hexdigest(),
            "feature": said, "codec": one.codec, "duration_s": one.seconds, "n_samples": len(one.spans), "keyframes": listed(one),
            "tracks": [{"codec": t.codec, "kind": t.kind, "duration_s": t.seconds, "n_samples": len(t.spans), "keyframes": listed(t)} for t in tracks],
        }

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(FEATURES))
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [features(x) for x in part.column(column).to_pylist()]
                cols = [pa.array([x.get(n) for x in found], arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([part.column(x) for x in rest] + cols, rest + names)

    return media.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every text stored as a media file, read back and described."""
    return describe(media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("error", "tracks")
