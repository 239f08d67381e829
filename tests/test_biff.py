"""Old binary workbooks: the same rows as their .xlsx twins, other layouts of the same file, damage."""

import io
import struct
import zipfile

import pytest

from thermocline.sources import biff, replica, text, workbook

ROWS = [["Price hub", None, "Größe", "日本 hub"], [1, 2.5, -3, 0.1], [None, "x" * 20000, 1e300, 123456789], [], [-0.25, 4e9, "", "end"]]


def rec(kind, *parts):
    return replica._record(kind, b"".join(parts))


def book(cells, globals_=b"", name="S"):
    begin = rec(biff.BOF, struct.pack("<4H2I", 0x600, 5, 0, 0, 0, 6))
    sheet = lambda at: rec(biff.SHEET, struct.pack("<IHBB", at, 0, len(name), 0), name.encode())
    at = len(begin) + len(sheet(0)) + len(globals_) + 4
    return begin + sheet(at) + globals_ + rec(biff.EOF) + rec(biff.BOF, struct.pack("<4H2I", 0x600, 16, 0, 0, 0, 6)) + cells + rec(biff.EOF)


def trimmed(rows):
    return [r[: max((k + 1 for k, x in enumerate(r) if x is not None), default=0)] for r in rows]


@pytest.mark.parametrize("most", [8224, 40, 23])
def test_cells_as_in_the_new_form(monkeypatch, most):
    small = replica._strings
    monkeypatch.setattr(replica, "_strings", lambda texts: small(texts, most))
    rows = [[x if x != "x" * 20000 or most == 8224 else "x" * 200 for x in r] for r in ROWS]
    assert workbook.sheets(replica.old_workbook("One", rows)) == {"One": trimmed(rows)} == {k: trimmed(v) for k, v in workbook.sheets(replica.workbook("One", rows)).items()}


def test_other_records():
    place = lambda i, k, style=0: struct.pack("<3H", i, k, style)
    formula = lambda i, k, value: rec(biff.FORMULA, place(i, k), value, bytes(8))
    chart = rec(biff.BOF, bytes(16)) + rec(biff.NUMBER, place(0, 0), struct.pack("<d", 99)) + rec(biff.EOF)
    cells = (
        chart
        + rec(biff.MUL_RK, struct.pack("<HH", 0, 0), struct.pack("<HI", 0, 7 << 2 | 2), struct.pack("<HI", 0, (-150 << 2 | 3) & 0xFFFFFFFF), struct.pack("<H", 1))
        + rec(biff.RK, place(0, 2), struct.pack("<d", 2.0)[4:])
        + formula(0, 3, struct.pack("<d", 4.5)) + formula(0, 4, b"\x00" + bytes(5) + b"\xff\xff") + rec(biff.STRING, struct.pack("<HB", 2, 0), b"ok") + formula(0, 5, b"\x01\x00\x01" + bytes(3) + b"\xff\xff") + formula(0, 6, b"\x02\x00\x07" + bytes(3) + b"\xff\xff")
        + rec(biff.BOOL, place(1, 0), b"\x01\x00") + rec(biff.BOOL, place(1, 1), b"\x07\x01") + rec(biff.LABEL, place(1, 2), struct.pack("<HB", 1, 1), "é".encode("utf-16-le"))
    )
    rich = struct.pack("<HBHI", 2, 0x0C, 1, 3) + b"ab" + bytes(4) + b"xyz" + struct.pack("<HB", 1, 0) + b"c"
    table = rec(biff.SST, struct.pack("<II", 2, 2), rich)
    cells += rec(biff.LABEL_SST, place(2, 0), struct.pack("<I", 0)) + rec(biff.LABEL_SST, place(2, 1), struct.pack("<I", 1))
    assert workbook.sheets(replica.compound("Workbook", book(cells, table))) == {"S": [[7.0, -1.5, 2.0, 4.5, "ok", True, None], [True, None, "é"], ["ab", "c"]]}


def test_days_of_either_system():
    style = lambda code: rec(biff.XF, struct.pack("<HH", 0, code), bytes(16))
    told = lambda code, said: rec(biff.FORMAT, struct.pack("<HHB", code, len(said), 0), said.encode())
    top = told(170, "yyyy-mm-dd") + told(171, '0.00 "days"') + style(0) + style(14) + style(170) + style(171)
    cells = b"".join(rec(biff.NUMBER, struct.pack("<3H", 0, k, k), struct.pack("<d", 100)) for k in range(4))
    assert biff.sheets(replica.compound("Workbook", book(cells, top)))["S"] == [[100.0] * 4]
    late = rec(biff.DATE_MODE, struct.pack("<H", 1)) + top
    assert biff.sheets(replica.compound("Workbook", book(cells, late)))["S"] == [[100.0, 1562.0, 1562.0, 100.0]]


def packed(data, order=None):
    """A compound file whose stream lies in short sectors; `order` shuffles the sectors of its container."""
    units = -(-len(data) // 64)
    body = data.ljust(-(-len(data) // 512) * 512, b"\0")
    blocks = len(body) // 512
    order = order or list(range(blocks))
    placed = [b""] * blocks
    for k, at in enumerate(order):
        placed[at] = body[512 * k : 512 * k + 512]
    table = [biff.FREE] * 128
    for k, at in enumerate(order):
        table[at] = order[k + 1] if k + 1 < blocks else biff.END
    table[blocks], table[blocks + 1], table[blocks + 2] = biff.END, biff.END, 0xFFFFFFFD
    small = [*range(1, units), biff.END] + [biff.FREE] * (128 - units)
    entry = lambda n, kind, start, size: (n.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB3I", 2 * len(n) + 2, kind, 1, biff.FREE, biff.FREE, 1) + bytes(36) + struct.pack("<IQ", start, size)
    directory = (entry("Root Entry", 5, order[0], len(body)) + entry("Workbook", 2, 0, len(data))).ljust(512, b"\0")
    head = biff.SIGNATURE + bytes(16) + struct.pack("<5H6x", 0x3E, 3, 0xFFFE, 9, 6) + struct.pack("<9I", 0, 1, blocks, 0, 4096, blocks + 1, 1, biff.END, 0)
    return head + struct.pack("<109I", blocks + 2, *[biff.FREE] * 108) + b"".join(placed) + directory + struct.pack("<128I", *small) + struct.pack("<128I", *table)


@pytest.mark.parametrize("order", [None, [2, 0, 1]])
def test_short_and_scattered_streams(order):
    cells = b"".join(rec(biff.NUMBER, struct.pack("<3H", k, 0, 0), struct.pack("<d", k)) for k in range(60))
    data = book(cells)
    assert 1024 < len(data) < 1536
    assert biff.sheets(packed(data, order))["S"] == [[float(k)] for k in range(60)]


def test_damage_is_an_error():
    good = replica.old_workbook("One", ROWS)
    bad = [
        b"", good[:600], good.replace("Workbook".encode("utf-16-le"), "Workbuch".encode("utf-16-le")), good[:512] + good[1024:],
        replica.compound("Workbook", book(b"", rec(biff.FILEPASS, bytes(4)))), replica.compound("Workbook", rec(biff.BOF, struct.pack("<HH", 0x500, 5))),
        replica.compound("Workbook", book(rec(biff.LABEL_SST, struct.pack("<3HI", 0, 0, 0, 5)))),
    ]
    for content in bad:
        with pytest.raises(text.SourceError):
            biff.sheets(content)
    with pytest.raises(text.SourceError):
        workbook.sheets(b"<html>no workbook</html>")


def test_a_folder_of_every_form(spark, tmp_path):
    head = ["Price Hub", "Trade Date", "Delivery Start Date", "Delivery \nEnd Date", "High Price", "Low Price", "Wtd Avg Price"]
    day = lambda d, price: [head, ["Mid C Peak", d, d, d, 3, 1, price]]
    (tmp_path / "ice_electric-2014final.xls").write_bytes(replica.old_workbook("a", day("2014-01-02", 2.25)))
    (tmp_path / "b.xlsx").write_bytes(replica.workbook("a", day("2014-01-03", 3)))
    serial = [head, ["SP15 EZ", 41700, 41701, 41701.0, 3, 1, 4.123]]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("c.xls", replica.old_workbook("a", serial))
        z.writestr("d.xlsx", replica.workbook("a", day("2014-01-06", 5)))
        z.writestr("notes.txt", "no workbook")
    (tmp_path / "z.zip").write_bytes(out.getvalue())
    got = sorted((r["hub"], str(r["delivery_start"]), r["price"], r["source"]) for r in workbook.wholesale(spark, str(tmp_path)).collect())
    assert got == [("MIDC", "2014-01-02", 2.25, "ice_electric-2014final.xls"), ("MIDC", "2014-01-03", 3.0, "b.xlsx"), ("MIDC", "2014-01-06", 5.0, "d.xlsx"), ("SP15", "2014-03-03", 4.123, "c.xls")]
