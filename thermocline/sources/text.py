"""Text sources: index tables, weekly fixed-width rows, year grids, climate divisions, daily gas prices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.functions.columns import month_start, null_if_sentinel, season_month

#: State numbers of the climate-division files (contiguous states).
STATE_CODES = dict(enumerate("AL AZ AR CA CO CT DE FL GA ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split(), 1))
#: Element number and missing value of the climate-division files.
ELEMENTS = {"tmpc": ("02", -99.9, "tmp"), "pcpn": ("01", -9.99, "pcpn"), "hddc": ("25", -9999.0, "hdd"), "cddc": ("26", -9999.0, "cdd")}


class SourceError(ValueError):
    """A file does not have the form its kind must have."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and its parts at blanks; latin-1."""
    return spark.read.option("encoding", "ISO-8859-1").text(path).withColumn("part", F.split(F.trim("value"), r"\s+")).where(F.trim("value") != "")


def demand(bad: DataFrame, what: str) -> None:
    """Raises SourceError if there is a row, and shows the first."""
    if row := bad.limit(1).collect():
        raise SourceError(f"{what}: {row[0][0]!r}")


def season_table(spark: SparkSession, path: str, header: list[str], columns: list[str]) -> DataFrame:
    """season, year, the columns, month, date of a season table; a wrong header, count or season raises."""
    rows = lines(spark, path)
    is_header = F.upper(F.trim("value")).startswith(header[0])
    found = rows.where(is_header).limit(2).collect()
    if len(found) != 1 or [x.upper() for x in found[0]["part"]] != header:
        raise SourceError(f"{path}: the header must be {' '.join(header)}")
    body = rows.where(~is_header)
    month = season_month(F.col("part")[0])
    good = (F.size("part") == len(header)) & month.isNotNull() & F.try_to_number(F.col("part")[1], F.lit("9999")).isNotNull()
    demand(body.where(~F.coalesce(good, F.lit(False))).select("value"), f"{path}: bad row")
    year = F.col("part")[1].cast("int")
    values = [F.col("part")[k + 2].cast("double").alias(c) for k, c in enumerate(columns)]
    return body.select(year.alias("year"), F.col("part")[0].alias("season"), *values, month.alias("month"), F.make_date(year, month, F.lit(1)).alias("date"))


def roni(spark: SparkSession, path: str) -> DataFrame:
    return season_table(spark, path, ["SEAS", "YR", "ANOM"], ["roni"])


def oni(spark: SparkSession, path: str) -> DataFrame:
    return season_table(spark, path, ["SEAS", "YR", "TOTAL", "ANOM"], ["oni_total", "oni"])


def weekly(spark: SparkSession, path: str) -> DataFrame:
    """week and eight values; numbers may touch (20.6-0.1); lines without a date are skipped, a wrong count raises."""
    rows = lines(spark, path).where(F.trim("value").rlike(r"^\d{2}[A-Za-z]{3}\d{4}"))
    rows = rows.select("value", F.regexp_extract_all(F.substring(F.trim("value"), 10, 1000), F.lit(r"-?\d+\.\d+"), F.lit(0)).alias("x"))
    demand(rows.where(F.size("x") != 8).select("value"), f"{path}: not eight values")
    names = [f"{n}_{k}" for n in ("nino12", "nino3", "nino34", "nino4") for k in ("sst", "anom")]
    week = F.to_date(F.initcap(F.substring(F.trim("value"), 1, 9)), "ddMMMyyyy")
    return rows.select(week.alias("week"), *[F.col("x")[k].cast("double").alias(n) for k, n in enumerate(names)])


def year_grid(spark: SparkSession, path: str, name: str) -> DataFrame:
    """year, month, value, date of a grid of years x 12; the line after the last year is the missing value."""
    whole = spark.read.option("encoding", "ISO-8859-1").text(path, wholetext=True)
    parts = whole.select(F.transform(F.filter(F.split("value", r"\n"), lambda x: F.trim(x) != ""), lambda x: F.split(F.trim(x), r"\s+")).alias("l"))
    sized = parts.select("l", F.col("l")[0][0].cast("int").alias("first"), F.col("l")[0][1].cast("int").alias("last"))
    sized = sized.select("l", "first", "last", (F.col("last") - F.col("first") + 1).alias("n"))
    missing = F.get(F.get("l", F.col("n") + 1), F.lit(0)).cast("double")
    rows = sized.select("first", missing.alias("missing"), F.posexplode(F.slice("l", F.lit(2), F.col("n"))).alias("k", "row"))
    bad = (F.size("row") != 13) | (F.col("row")[0].cast("int") != F.col("first") + F.col("k"))
    demand(rows.where(bad).select(F.array_join("row", " ")), f"{path}: rows out of order or incomplete")
    cells = rows.select(F.col("row")[0].cast("int").alias("year"), "missing", F.posexplode(F.slice("row", 2, 12)).alias("m", "v"))
    cells = cells.select("year", (F.col("m") + 1).alias("month"), F.col("v").cast("double").alias("v"), "missing")
    return cells.where(F.abs(F.col("v") - F.col("missing")) >= 1e-6).select("year", "month", F.col("v").alias(name), F.make_date("year", "month", F.lit(1)).alias("date"))


def climate_divisions(spark: SparkSession, path: str, element: str, states: int = 48) -> DataFrame:
    """state, year, month, value of one element; other regions are skipped, another element or state count raises."""
    code, missing, name = ELEMENTS[element]
    rows = lines(spark, path).select("value", F.col("part")[0].alias("key"), F.slice("part", 2, 12).alias("v"))
    demand(rows.where((F.length("key") != 10) | (F.size("v") != 12) | (F.substring("key", 5, 2) != code)).select("value"), f"{path}: bad row for {element}")
    names = F.create_map(*[x for k, s in STATE_CODES.items() for x in (F.lit(k), F.lit(s))])
    rows = rows.select(F.try_element_at(names, F.substring("key", 1, 3).cast("int")).alias("state"), F.substring("key", 7, 4).cast("int").alias("year"), "v").where(F.col("state").isNotNull())
    cells = rows.select("state", "year", F.posexplode("v").alias("m", "x")).select("state", "year", (F.col("m") + 1).alias("month"), null_if_sentinel(F.col("x").cast("double"), missing).alias(name)).where(F.col(name).isNotNull())
    if (n := cells.agg(F.countDistinct("state")).first()[0]) != states:
        raise SourceError(f"{path}: {n} states, not {states}")
    return cells


def climate(elements: list[DataFrame]) -> DataFrame:
    """The elements side by side, full outer on state, year, month."""
    return reduce(lambda a, b: a.join(b, ["state", "year", "month"], "full"), elements)


def gas_prices(spark: SparkSession, path: str) -> DataFrame:
    """date, henry_hub; a point or blank is no price and the row is left out. Not two columns: raises."""
    rows = spark.read.csv(path, header=True)
    if len(rows.columns) != 2:
        raise SourceError(f"{path}: {len(rows.columns)} columns, not 2")
    day, price = rows.columns
    return rows.select(F.expr(f"try_to_date(`{day}`)").alias("date"), F.expr(f"try_cast(`{price}` AS double)").alias("henry_hub")).dropna()


def latest(names: list[str], element: str) -> str:
    """The file of an element with the latest date suffix; unfinished downloads do not count."""
    found = [n for n in names if element in n and not n.endswith(".part")]
    if not found:
        raise SourceError(f"no file for {element}")
    return max(found, key=lambda n: n.rsplit("-", 1)[-1])


def with_dates(rows: DataFrame, year: str = "year", month: str = "month") -> DataFrame:
    """date (first of the month) and days."""
    date: Column = month_start(F.make_date(year, month, F.lit(1)))
    return rows.withColumn("date", date).withColumn("days", F.dayofmonth(F.last_day(date)))
