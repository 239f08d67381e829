"""Old binary workbooks (.xls): a reader of compound files and of the BIFF8 records in them.

A compound file is a small file system: sectors chained by a table, a directory of streams, and short
streams packed into one of their own. Its stream "Workbook" holds records: globals (shared strings,
formats, sheets), then each sheet's cells. Formats follow the published MS-CFB and MS-XLS documents.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from thermocline.sources.text import SourceError

SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
#: Record numbers of BIFF8.
BOF, EOF, SHEET, SST, CONTINUE, LABEL_SST, NUMBER, RK, MUL_RK, FORMULA, STRING, LABEL, BOOL, FILEPASS, DATE_MODE, FORMAT, XF = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0xFD, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x204, 0x205, 0x2F, 0x22, 0x41E, 0xE0
#: Built-in number formats that show dates or times; days between the two date systems.
DATES, SHIFT = {*range(14, 23), *range(45, 48)}, 1462


def _chain(table: list[int], start: int) -> Iterator[int]:
    seen = 0
    while start != END:
        if start >= len(table) or seen > len(table):
            raise SourceError("a chain of sectors is broken")
        yield start
        start, seen = table[start], seen + 1


def stream(content: bytes, *names: str) -> bytes:
    """The first of the named streams of a compound file."""
    if content[:8] != SIGNATURE or len(content) < 512:
        raise SourceError("not a compound file")
    shift, small_shift = struct.unpack_from("<HH", content, 30)
    first_directory, = struct.unpack_from("<I", content, 48)
    cutoff, first_small, _, next_map, _ = struct.unpack_from("<5I", content, 56)
    size = 1 << shift

    def sector(n: int) -> bytes:
        piece = content[(n + 1) * size : (n + 2) * size]
        if not piece:
            raise SourceError("a sector lies beyond the end of the file")
        return piece.ljust(size, b"\0")

    numbers = lambda piece: list(struct.unpack(f"<{len(piece) // 4}I", piece))
    maps = [x for x in struct.unpack_from("<109I", content, 76) if x < END]
    seen = 0
    while next_map < END:
        own = numbers(sector(next_map))
        maps += [x for x in own[:-1] if x < END]
        next_map, seen = own[-1], seen + 1
        if seen > len(content) // size:
            raise SourceError("a chain of sectors is broken")
    table = [x for n in maps for x in numbers(sector(n))]
    chained = lambda start: b"".join(map(sector, _chain(table, start)))

    directory, found = chained(first_directory), {}
    for at in range(0, len(directory) - 127, 128):
        length, kind = struct.unpack_from("<HB", directory, at + 64)
        start, long = struct.unpack_from("<IQ", directory, at + 116)
        if kind in (2, 5) and 2 <= length <= 64:
            found.setdefault("" if kind == 5 else directory[at : at + length - 2].decode("utf-16-le").lower(), (start, long & 0xFFFFFFFF if shift == 9 else long))
    hit = next((found[n.lower()] for n in names if n.lower() in found), None)
    if hit is None:
        raise SourceError(f"a compound file without a stream {' or '.join(names)}")
    start, long = hit
    if long >= cutoff:
        data = chained(start)
    else:
        packed, step = chained(found[""][0]), 1 << small_shift
        small = [x for n in _chain(table, first_small) for x in numbers(sector(n))]
        data = b"".join(packed[n * step : (n + 1) * step] for n in _chain(small, start))
    if len(data) < long:
        raise SourceError("a stream is shorter than its directory says")
    return data[:long]


def records(data: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(number, parts): a record's own bytes and those of the records that continue it."""
    at, held = 0, None
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise SourceError("a record is cut off")
        if kind == CONTINUE and held:
            held[1].append(body)
        else:
            if held:
                yield held
            held = (kind, [body])
        at += 4 + size
        if kind == 0 and size == 0:
            break
    if held:
        yield held


class Parts:
    """A reader over a record's parts: numbers run on, characters begin anew with their own width in each part."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def bytes(self, n: int) -> bytes:
        out = b""
        while n:
            if self.part >= len(self.parts):
                raise SourceError("a string table is cut off")
            piece = self.parts[self.part][self.at : self.at + n]
            out, n, self.at = out + piece, n - len(piece), self.at + len(piece)
            if n:
                self.part, self.at = self.part + 1, 0
        return out

    def number(self, form: str) -> int:
        return struct.unpack("<" + form, self.bytes(struct.calcsize(form)))[0]

    def characters(self, n: int, wide: int) -> str:
        out = ""
        while True:
            left = (len(self.parts[self.part]) - self.at) // (2 if wide else 1)
            own = min(n, left)
            out += self.bytes(own * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "surrogatepass")
            n -= own
            if not n:
                return out
            if self.part + 1 >= len(self.parts):
                raise SourceError("a string is cut off")
            self.part, self.at = self.part + 1, 0
            wide = self.number("B") & 1

    def string(self, length: str = "H") -> str:
        """A string with its flags; runs of fonts and phonetic data behind it are skipped."""
        n, flags = self.number(length), self.number("B")
        fonts = self.number("H") if flags & 8 else 0
        extra = self.number("I") if flags & 4 else 0
        text = self.characters(n, flags & 1) if n else ""
        self.bytes(4 * fonts + extra)
        return text


def rk(x: int) -> float:
    """A packed number: 30 bits of an integer or of a double's head, perhaps in hundredths."""
    value = float(x >> 2) - (1 << 30 if x >> 31 else 0) if x & 2 else struct.unpack("<d", struct.pack("<II", 0, x & 0xFFFFFFFC))[0]
    return value / 100 if x & 1 else value


def _dated(code: str) -> bool:
    """Whether a number format shows a date: it asks for days, months or years outside quotes and brackets."""
    return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code.lower()).replace("general", "")))


def sheets(content: bytes) -> dict[str, list[list[object]]]:
    """Sheet name: rows of cell values (str, float, bool or None), from the bytes of an .xls file.

    Days of the 1904 date system become those of the usual one. Errors and blanks are None; formulas
    give their stored values. Encrypted files and those before BIFF8 raise.
    """
    data = stream(content, "Workbook", "Book")
    places: list[tuple[str, int]] = []
    shared: list[str] = []
    formats: dict[int, str] = {}
    styles: list[int] = []
    late = False
    for n, (kind, parts) in enumerate(records(data)):
        own = Parts(parts)
        if n == 0:
            if kind != BOF or own.number("H") != 0x600:
                raise SourceError("an .xls file before BIFF8")
        elif kind == FILEPASS:
            raise SourceError("an encrypted .xls file")
        elif kind == SHEET:
            at, flags = own.number("I"), own.number("H")
            name = own.string("B")
            if not flags >> 8:  # worksheets only
                places.append((name, at))
        elif kind == SST:
            own.number("I")
            shared = [own.string() for _ in range(own.number("I"))]
        elif kind == DATE_MODE:
            late = bool(own.number("H"))
        elif kind == FORMAT:
            code = own.number("H")
            formats[code] = own.string()
        elif kind == XF:
            own.number("H")
            styles.append(own.number("H"))
        elif kind == EOF:
            break
    dated = [f in DATES or _dated(formats.get(f, "")) for f in styles]
    moved = lambda x, style: x + SHIFT if late and style < len(dated) and dated[style] else x
    return {name: _cells(data[at:], shared, moved) for name, at in places}


def _cells(data: bytes, shared: list[str], moved) -> list[list[object]]:
    cells: dict[tuple[int, int], object] = {}
    depth, waits = 0, None
    for kind, parts in records(data):
        body = parts[0]
        if kind == BOF:
            depth += 1
        elif kind == EOF:
            depth -= 1
            if not depth:
                break
        elif depth > 1:  # of a chart within the sheet
            continue
        elif kind == STRING:
            if waits is not None:
                cells[waits], waits = Parts(parts).string(), None
        elif kind == MUL_RK:
            row, first = struct.unpack_from("<HH", body)
            for k in range((len(body) - 6) // 6):
                style, x = struct.unpack_from("<HI", body, 4 + 6 * k)
                cells[row, first + k] = moved(rk(x), style)
        elif kind in (LABEL_SST, NUMBER, RK, FORMULA, LABEL, BOOL):
            row, column, style = struct.unpack_from("<3H", body)
            if kind == LABEL_SST:
                k = struct.unpack_from("<I", body, 6)[0]
                if k >= len(shared):
                    raise SourceError("a cell of no shared string")
                cells[row, column] = shared[k]
            elif kind == RK:
                cells[row, column] = moved(rk(struct.unpack_from("<I", body, 6)[0]), style)
            elif kind == LABEL:
                cells[row, column] = Parts([body[6:], *parts[1:]]).string()
            elif kind == BOOL:
                cells[row, column] = None if body[7] else bool(body[6])
            elif kind == NUMBER or body[12:14] != b"\xff\xff":
                cells[row, column] = moved(struct.unpack_from("<d", body, 6)[0], style)
            elif body[6] == 0:
                waits = (row, column)
            else:
                cells[row, column] = bool(body[8]) if body[6] == 1 else None
    width: dict[int, int] = {}
    for row, column in cells:
        width[row] = max(width.get(row, 0), column + 1)
    return [[cells.get((row, k)) for k in range(width.get(row, 0))] for row in range(max(width, default=-1) + 1)]
