import datetime as dt
import http.client
import io
import types
import urllib.error
import zipfile

import pytest

from thermocline.sources import download, text, workbook


def put(folder, name, body):
    (folder / name).write_text(body, encoding="latin-1")
    return str(folder / name)


def test_season_tables(spark, tmp_path):
    rows = text.roni(spark, put(tmp_path, "r.txt", "SEAS   YR  ANOM\nDJF  1950 -1.19\nNDJ  2015  2.20\n")).orderBy("date").collect()
    assert [(r["date"], r["roni"]) for r in rows] == [(dt.date(1950, 1, 1), -1.19), (dt.date(2015, 12, 1), 2.2)]
    assert text.oni(spark, put(tmp_path, "o.txt", " SEAS  YR   TOTAL   ANOM\n  JAS 2026  29.12   2.16\n")).first()["month"] == 8
    for body in ("<html>error</html>\n", "SEAS   YR  ANOM\nXYZ  1950 -1.19\n", "SEAS YR ANOM\nDJF 1950\n"):
        with pytest.raises(text.SourceError):
            text.roni(spark, put(tmp_path, "bad.txt", body)).collect()


def test_weekly_numbers_that_touch(spark, tmp_path):
    body = " head\n\n Week          SST SSTA\n 02SEP1981     20.6-0.1     24.8-0.1     26.5-0.2     28.3-0.3\n 23SEP2026     25.4 4.7     28.8 3.9     29.7 3.1     29.8 1.1\n"
    rows = text.weekly(spark, put(tmp_path, "w.for", body)).orderBy("week").collect()
    assert [(r["week"], r["nino34_anom"]) for r in rows] == [(dt.date(1981, 9, 2), -0.2), (dt.date(2026, 9, 23), 3.1)]


def test_year_grid_drops_missing(spark, tmp_path):
    body = "\n".join([" 1870 1871", " 1870 " + " ".join(["  0.50"] * 12), " 1871 " + " ".join(["  1.00"] * 6 + [" -99.99"] * 6), "  -99.99", "  NINA34"]) + "\n"
    rows = text.year_grid(spark, put(tmp_path, "g.data", body), "nino34").orderBy("date").collect()
    assert len(rows) == 18 and rows[-1]["date"] == dt.date(1871, 6, 1)


def test_climate_divisions(spark, tmp_path):
    line = lambda code, element, first: f"{code:03d}0{element}2000 " + " ".join([first, *["1.00"] * 11])
    body = "\n".join([*(line(k, "02", "-99.90") for k in range(1, 49)), line(110, "02", "5.00")]) + "\n"
    rows = text.climate_divisions(spark, put(tmp_path, "c", body), "tmpc")
    assert rows.count() == 48 * 11 and rows.where("month = 1").count() == 0
    with pytest.raises(text.SourceError):
        text.climate_divisions(spark, put(tmp_path, "d", line(1, "01", "1.00") + "\n"), "tmpc")
    with pytest.raises(text.SourceError):
        text.climate_divisions(spark, put(tmp_path, "e", line(1, "02", "1.00") + "\n"), "tmpc")


def test_gas_prices(spark, tmp_path):
    got = text.gas_prices(spark, put(tmp_path, "g.csv", "observation_date,DHHNGSP\n1997-01-07,3.82\n1997-01-08,\n1997-01-09,.\n")).collect()
    assert [(r["date"], r["henry_hub"]) for r in got] == [(dt.date(1997, 1, 7), 3.82)]


def xlsx(rows, sheet="Monthly"):
    cell = lambda x: f'<c t="inlineStr"><is><t>{x}</t></is></c>' if isinstance(x, str) else f"<c><v>{x}</v></c>"
    name = lambda k: chr(65 + k)
    body = "".join(f'<row r="{i + 1}">' + "".join(cell(x).replace("<c", f'<c r="{name(k)}{i + 1}"', 1) for k, x in enumerate(r) if x is not None) + "</row>" for i, r in enumerate(rows))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{sheet}" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="a" Target="worksheets/s.xml"/></R>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


RETAIL = [[None] * 4 + ["RESIDENTIAL", None, None, None], [None] * 4 + ["Revenue", "Sales", "Customers", "Price"], ["Year", "Month", "State", "Data Status"], [2020, 1, "TX", "Final", 5.0, ".", 7, 8.5], ["note"]]


def test_retail_workbook_and_overlap(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx(RETAIL))
    row = workbook.retail(spark, [str(tmp_path / "a.xlsx")]).first()
    assert (row["state"], row["sector"], row["sales_mwh"], row["price_cents"]) == ("TX", "residential", None, 8.5)
    (tmp_path / "b.xlsx").write_bytes(xlsx(RETAIL))
    with pytest.raises(text.SourceError):
        workbook.retail(spark, [str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx")])
    with pytest.raises(text.SourceError):
        workbook.retail_rows([r[:7] for r in RETAIL])


def test_wholesale_keeps_the_last_row(spark, tmp_path):
    head = ["Price Hub", "Trade Date", "Delivery Start Date", "Delivery \nEnd Date", "High Price", "Low Price", "Wtd Avg Price"]
    rows = [head, ["Mid C Peak", "2020-01-01", "2020-01-02", "2020-01-02", 3, 1, 2], ["Mid C Peak", "2020-01-01", "2020-01-02", "2020-01-02", 3, 1, 2.5], ["Mid C Peak", "x", "bad", "bad", 3, 1, 9]]
    (tmp_path / "w.xlsx").write_bytes(xlsx(rows))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.xlsx", xlsx([head, ["SP15 EZ", "2020-01-01", "2020-01-03", "2020-01-03", 3, 1, 4]]))
    got = {(r["hub"], r["price"]) for r in workbook.wholesale(spark, str(tmp_path)).collect()}
    assert got == {("MIDC", 2.5), ("SP15", 4.0)}


class Answer(io.BytesIO):
    def __init__(self, body, status, length):
        super().__init__(body)
        self.status, self.headers = status, {"Content-Length": str(length)}


def test_download_resumes_after_a_short_body(tmp_path):
    body, asked = b"PK\x03\x04" + bytes(100), []

    def opener(request, timeout):
        asked.append(request.headers.get("Range"))
        if len(asked) == 1:
            return Answer(body[:50], 200, len(body))
        return Answer(body[50:], 206, len(body) - 50)

    entry = download.fetch(download.Target("s", "http://localhost/x", "x.zip"), tmp_path, download.Settings(retries=1), opener, sleep=lambda s: None)
    assert asked == [None, "bytes=50-"] and entry["bytes"] == len(body) and (tmp_path / "s/x.zip").read_bytes() == body


@pytest.mark.parametrize("total, asked", [(104, ["bytes=104-"]), (90, ["bytes=104-", None])])
def test_a_range_beyond_the_end_is_a_whole_file_or_another(tmp_path, total, asked):
    body, seen = b"PK\x03\x04" + bytes(100), []
    (tmp_path / "s").mkdir()
    (tmp_path / "s/x.zip.part").write_bytes(body)

    def opener(request, timeout):
        seen.append(request.headers.get("Range"))
        if seen[-1]:
            raise urllib.error.HTTPError(request.full_url, 416, "range", {"Content-Range": f"bytes */{total}"}, None)
        return Answer(body[:90], 200, 90)

    entry = download.fetch(download.Target("s", "http://localhost/x", "x.zip"), tmp_path, download.Settings(retries=2), opener, sleep=lambda s: None)
    assert seen == asked and entry["bytes"] == total


def test_broken_connections_and_wrong_content_are_tried_again(tmp_path):
    answers = [http.client.IncompleteRead(b""), Answer(b"<html>", 200, 6), Answer(b"a,b\n", 200, 4)]

    def opener(request, timeout):
        got = answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    pauses = []
    assert download.fetch(download.Target("s", "http://localhost/x", "x.csv"), tmp_path, download.Settings(retries=3, backoff_s=1), opener, pauses.append)["bytes"] == 4
    assert pauses == [1, 2] and not answers


def test_plan_reads_the_stamp_and_the_page():
    pages = {"https://h/d/procdate.txt": b"20260105\n", "https://h/w": b"<a href='f/ice_electric-2026.xlsx'>x</a><a href='f/ice_electric-notes.pdf'>"}
    s = types.SimpleNamespace(roni="https://h/r.txt", oni="https://h/o.txt", weekly="https://h/w.for", nino34_long="https://h/n.data", retail="https://h/a.xlsx", retail_history="https://h/b.xlsx", henry_hub="https://h/g?id=1", climdiv_base="https://h/d/", climdiv_elements=["tmpc"], wholesale_index="https://h/w", wholesale_pattern="ice_electric")
    found = download.plan(s, download.Settings(), lambda r, timeout: Answer(pages[r.full_url], 200, 0))
    assert [t.relpath for t in found] == ["enso/r.txt", "enso/o.txt", "enso/w.for", "enso/n.data", "retail/a.xlsx", "retail/b.xlsx", "gas/henry_hub.csv", "climdiv/climdiv-tmpcst-v1.0.0-20260105", "wholesale/ice_electric-2026.xlsx"]
    with pytest.raises(download.DownloadError):
        download.plan(s, download.Settings(retries=0), lambda r, timeout: Answer(b"nothing", 200, 0))


def test_download_rejects_pages_and_plans_links(tmp_path):
    assert download.objection(b"<html>", "csv") and download.objection(b"", "csv") and download.objection(b"PK", "xlsx")
    assert download.objection(b"a,b", "csv") is None and download.objection(b"PK\x03\x04rest", "zip") is None
    assert download.links('<A HREF="a/ice_electric-1.xlsx"><a href=\'a/ice_electric-1.xlsx\'><a href="b">', "https://h/p/", "ice_electric") == ["https://h/p/a/ice_electric-1.xlsx"]
    settings = download.Settings(retries=0)
    with pytest.raises(download.DownloadError):
        download.run([download.Target("s", "http://localhost/x", "x.csv")], tmp_path, settings, opener=lambda r, timeout: Answer(b"<html>", 200, 6), log=lambda s: None)
    assert (tmp_path / "manifest.json").exists()
