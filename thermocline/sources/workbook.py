"""Workbooks without a library: .xlsx is zipped XML, .xls see biff. Retail sheets and wholesale price files."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.functions.columns import canonical_name
from thermocline.operators.relational import keep_last
from thermocline.sources import biff
from thermocline.sources.text import SourceError

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Columns of wholesale files by the beginning of their header, and those that must be there.
WHOLESALE = [("price hub", "hub"), ("trade date", "trade_date"), ("delivery start", "delivery_start"), ("delivery end", "delivery_end"), ("high price", "high"), ("low price", "low"), ("wtd avg", "price"), ("daily volume", "volume_mwh"), ("number of trades", "trades"), ("number of counterparties", "counterparties"), ("number of companies", "counterparties")]
NEEDED = ("hub", "trade_date", "delivery_start", "price", "delivery_end")
#: Measures of retail sheets by the beginning of their header.
MEASURES = [("revenue", "revenue_k"), ("sales", "sales_mwh"), ("customers", "customers"), ("price", "price_cents")]
KEYS = ["Year", "Month", "State", "Data Status"]


def sheets(content: bytes) -> dict[str, list[list[object]]]:
    """Sheet name: rows of cell values (str, float or None), from the bytes of an .xlsx or .xls file; the bytes tell which."""
    if content.startswith(biff.SIGNATURE):
        return biff.sheets(content)
    if not zipfile.is_zipfile(io.BytesIO(content)):
        raise SourceError("neither an .xlsx nor an .xls file")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        return {s.get("name"): _rows(z.read(f"xl/{targets[s.get(LINK)]}"), shared) for s in book.iter(f"{MAIN}sheet")}


def _rows(xml: bytes, shared: list[str]) -> list[list[object]]:
    out: list[list[object]] = []
    for row in ElementTree.fromstring(xml).iter(f"{MAIN}row"):
        cells: dict[int, object] = {}
        for cell in row.iter(f"{MAIN}c"):
            name = re.match("[A-Z]+", cell.get("r", "A"))[0]
            at = 0
            for ch in name:
                at = at * 26 + ord(ch) - 64
            value = cell.find(f"{MAIN}v")
            if cell.get("t") == "inlineStr":
                cells[at - 1] = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
            elif value is not None and value.text is not None:
                cells[at - 1] = shared[int(value.text)] if cell.get("t") == "s" else value.text if cell.get("t") == "str" else float(value.text)
        number = int(row.get("r", len(out) + 1))
        out += [[] for _ in range(number - 1 - len(out))]
        out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return out


def _number(x: object) -> float | None:
    try:
        return float(str(x).replace(",", ""))
    except ValueError:
        return None


def retail_rows(table: list[list[object]]) -> list[dict]:
    """Long rows of a retail sheet: three header rows (sector, measure, keys), then blocks of measures by sector."""
    if len(table) < 4:
        raise SourceError("a retail sheet has three header rows")
    width = max(map(len, table))
    wide = [[*r, *[None] * (width - len(r))] for r in table]
    if [str(x or "").strip() for x in wide[2][:4]] != KEYS:
        raise SourceError(f"a retail sheet begins with {', '.join(KEYS)}")
    sector, where = None, {}
    for k in range(4, width):
        sector = str(wide[0][k]).strip().lower() if wide[0][k] else sector
        measure = next((m for said, m in MEASURES if str(wide[1][k] or "").strip().lower() == said), None)
        if sector:
            where.setdefault(sector, {}).update({measure: k} if measure else {})
    if lost := [s for s, m in where.items() if len(m) != len(MEASURES)]:
        raise SourceError(f"sectors without four measures: {', '.join(lost)}")
    out = []
    for row in wide[3:]:
        year, month = _number(row[0]), _number(row[1])
        if year is None or month is None:
            continue
        for name, at in where.items():
            out.append({"state": str(row[2]).strip(), "year": int(year), "month": int(month), "status": str(row[3]).strip(), "sector": name} | {m: _number(row[k]) for m, k in at.items()})
    return out


RETAIL = "state string, year int, month int, status string, sector string, revenue_k double, sales_mwh double, customers double, price_cents double"


def retail(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All retail workbooks as one long table, a workbook a task; overlapping keys raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                book = {k.lower(): v for k, v in sheets(content).items()}
                table = book.get("monthly-states") or book.get("monthly")
                if table is None:
                    raise SourceError("no sheet Monthly-States or Monthly")
                yield pd.DataFrame(retail_rows(table))

    rows = spark.read.format("binaryFile").load(paths).select("content").mapInPandas(run, RETAIL)
    twice = rows.groupBy("state", "year", "month", "sector").count().where("count > 1").limit(1).collect()
    if twice:
        raise SourceError(f"files overlap at {tuple(twice[0])[:4]}")
    return rows


def _day(x: object) -> dt.date | None:
    if isinstance(x, (int, float)):
        return dt.date(1899, 12, 30) + dt.timedelta(days=int(x))
    found = pd.to_datetime(str(x), errors="coerce")
    return None if pd.isna(found) else found.date()


def wholesale_rows(table: list[list[object]], source: str) -> list[dict]:
    """Rows of a wholesale sheet; headers by their beginning, spaces squeezed; bad dates and numbers are null."""
    header = [re.sub(r"\s+", " ", str(x or "")).strip().lower() for x in table[0]] if table else []
    where: dict[str, int] = {}
    for k, said in enumerate(header):
        name = next((c for begin, c in WHOLESALE if said.startswith(begin)), None)
        if name and name not in where:
            where[name] = k
    if lost := [c for c in NEEDED if c not in where]:
        raise SourceError(f"{source}: no column {', '.join(lost)}")
    out = []
    for n, row in enumerate(table[1:]):
        cell = lambda c, row=row: row[where[c]] if c in where and where[c] < len(row) else None
        out.append({"raw_hub": cell("hub"), "source": source, "line": n} | {c: _day(cell(c)) for c in ("trade_date", "delivery_start", "delivery_end")} | {c: _number(cell(c)) for c in ("high", "low", "price", "volume_mwh", "trades", "counterparties")})
    return [r for r in out if r["raw_hub"] and r["trade_date"] and r["delivery_start"] and r["price"] is not None]


WHOLESALE_SCHEMA = "raw_hub string, source string, line int, trade_date date, delivery_start date, delivery_end date, high double, low double, price double, volume_mwh double, trades double, counterparties double"


def wholesale(spark: SparkSession, folder: str) -> DataFrame:
    """Wholesale prices of .xlsx and .xls files and of those inside .zip files; the last row of a hub and day holds.

    An unknown hub raises, and so does a file that is no workbook.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                files = [(path, content)]
                if path.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        files = [(f"{path}/{n}", z.read(n)) for n in sorted(z.namelist()) if n.lower().endswith((".xlsx", ".xls"))]
                for name, data in files:
                    book = list(sheets(data).values())
                    yield pd.DataFrame(wholesale_rows(book[0] if book else [], name.rsplit("/", 1)[-1]))

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,zip,xls}").load(folder).select("path", "content").mapInPandas(run, WHOLESALE_SCHEMA)
    named = rows.withColumn("hub", canonical_name(F.col("raw_hub")))
    if lost := named.where("hub is null").select("raw_hub").limit(1).collect():
        raise SourceError(f"unknown hub {lost[0][0]!r}")
    return keep_last(named, ["hub", "delivery_start"], F.desc_nulls_last("trade_date"), F.desc("source"), F.desc("line")).drop("line")
