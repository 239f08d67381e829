"""The build: raw files to silver tables to gold tables, checked and put in place at once."""

from __future__ import annotations

import hashlib
import json
import platform
import time
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.config import Config
from thermocline.functions.columns import winter_label
from thermocline.operators import quality
from thermocline.operators import relational as R
from thermocline.plans import checks, warehouse
from thermocline.session import written
from thermocline.sources import download, text, workbook

VERSION = "0.2"


def silver(spark: SparkSession, cfg: Config) -> dict[str, DataFrame]:
    """The parsed raw files."""
    raw, s = cfg.path("raw"), cfg.sources
    at = lambda source, url: str(raw / source / url.rsplit("/", 1)[-1])
    season = text.roni(spark, at("enso", s.roni)).drop("month", "date").join(text.oni(spark, at("enso", s.oni)).drop("month", "date"), ["year", "season"], "full")
    month = text.season_month(F.col("season"))
    present = [p.name for p in (raw / "climdiv").iterdir()]
    elements = [text.climate_divisions(spark, str(raw / "climdiv" / text.latest(present, e)), e) for e in s.climdiv_elements]
    return {
        "enso_season": season.withColumn("month", month).withColumn("date", F.make_date("year", month, F.lit(1))),
        "enso_week": text.weekly(spark, at("enso", s.weekly)),
        "nino34_month": text.year_grid(spark, at("enso", s.nino34_long), "nino34"),
        "climate_month": text.with_dates(text.climate(elements).where(F.col("year") >= cfg.climate.first_year)),
        "retail_month": text.with_dates(workbook.retail(spark, [at("retail", s.retail_history), at("retail", s.retail)])),
        "price_day": workbook.wholesale(spark, str(raw / "wholesale")).withColumnRenamed("delivery_start", "date"),
        "gas_day": text.gas_prices(spark, str(raw / "gas" / "henry_hub.csv")),
    }


def gold(spark: SparkSession, cfg: Config, t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """silver and what is derived from it."""
    index, fit = warehouse.harmonised(t["enso_season"].where("roni is not null"), t["nino34_month"], cfg.enso.base_window_years, cfg.enso.base_step_years, cfg.enso.base_anchor_year)
    states = warehouse.states(spark, cfg, t["retail_month"])
    member = warehouse.unit_members(states)
    gas = warehouse.gas_month(t["gas_day"])
    return t | {
        "enso_month": index,
        "enso_calibration": fit,
        "state": states,
        "unit_member": member,
        "unit_climate": warehouse.unit_climate(t["climate_month"], states, member),
        "unit_sales": warehouse.unit_sales(t["retail_month"], member),
        "gas_month": gas,
        "price_month": warehouse.price_month(t["price_day"], gas, cfg.prices.min_days),
        "source_file": download.manifest_table(spark, cfg.path("raw")),
    }


def build(spark: SparkSession, cfg: Config) -> DataFrame:
    """Writes silver and gold tables; gives the checks. A failed check of severity error leaves the old gold tables in place."""
    parsed = {name: rows for name, rows in silver(spark, cfg).items()}
    warehouse.save(parsed, str(cfg.path("silver")))
    tables = gold(spark, cfg, warehouse.tables(spark, str(cfg.path("silver"))))
    found = written(checks.all_checks(tables, cfg), "checks")
    quality.enforce(found)
    warehouse.save(tables | {"quality": found}, str(cfg.path("gold")))
    return found


def winters(index: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(events, winters with label, predictor, djf, phase, category, event) from the monthly index."""
    e = cfg.enso
    series = index.select(F.lit("index").alias("k"), "date", F.col("index").alias("v"))
    events = R.runs(series, ["k"], "date", "v", e.threshold, e.min_months).drop("k")
    name = F.concat(F.when(F.col("phase") == "warm", "EN").otherwise("LN"), F.year("first").cast("string"))
    events = events.withColumn("event_id", name).withColumn("phase", F.when(F.col("phase") == "warm", "el_nino").otherwise("la_nina"))
    edges = list(e.strength_edges)
    size = F.array_max(F.filter(F.array(*[F.struct(F.lit(x).alias("e"), F.lit(n).alias("n")) for x, n in zip(edges, ("weak", "moderate", "strong", "very_strong"), strict=True)]), lambda x: x["e"] <= F.greatest(F.abs("peak"), F.lit(edges[0]))))["n"]
    events = events.withColumn("strength", size)
    own = lambda m, shift, to: index.where(F.month("date") == m).select((F.year("date") - shift).alias("winter"), F.col("index").alias(to), F.col("date").alias(f"{to}_date"))
    rows = own(e.predictor_month, 0, "predictor").join(own(1, 1, "djf"), "winter", "left")
    rows = rows.withColumn("at", F.coalesce("djf_date", "predictor_date"))
    met = R.covering(rows, "at", events.select("first", "last", "phase", "strength", "event_id"))
    phase = F.coalesce("phase", F.lit("neutral"))
    category = F.when(phase == "neutral", "neutral").otherwise(F.concat_ws("_", "strength", "phase"))
    return events, met.select("winter", winter_label(F.col("winter")).alias("label"), "predictor", "djf", phase.alias("phase"), category.alias("category"), F.coalesce("event_id", F.lit("")).alias("event_id"))


def run_record(spark: SparkSession, config: Path, began: float, tables: int) -> DataFrame:
    """One row: version, time of the end in UTC, seconds, Python, digest of the settings, number of tables."""
    row = (VERSION, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), round(time.time() - began, 1), platform.python_version(), hashlib.sha256(config.read_bytes()).hexdigest(), tables)
    return spark.createDataFrame([row], "version string, finished_utc string, seconds double, python string, config_sha256 string, tables long")


def analyze(spark: SparkSession, cfg: Config, config: Path, resume: bool = False) -> dict[str, DataFrame]:
    """The study's tables (see study) beside the gold ones, with a run record; resume takes up a study that failed."""
    from thermocline.plans import study

    began, folder = time.time(), str(cfg.path("gold"))
    study.run(spark, cfg, folder, resume=resume)
    status = outlook_status(warehouse.tables(spark, folder), cfg)
    warehouse.save({"outlook_status": status, "run_info": run_record(spark, config, began, len(warehouse.tables(spark, folder)) + 2)}, folder, add=True)
    return warehouse.tables(spark, folder)


def outlook_status(t: dict[str, DataFrame], cfg: Config) -> DataFrame:
    """key, value: the index's latest month, its rank among the same calendar months, and the predictor of the outlook's winter."""
    rows = t["enso_month"].where(F.col("index").isNotNull())
    latest = rows.agg(F.max("date").alias("m"), F.max_by("index", "date").alias("now"))
    same = rows.crossJoin(F.broadcast(latest)).where(F.month("date") == F.month("m"))  # one row
    one = same.groupBy("m", "now").agg((F.count_if(F.col("index") > F.col("now")) + 1).alias("rank"), F.count("*").alias("years"))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (("latest_month", F.date_format("m", "yyyy-MM")), ("latest_index", F.round("now", 2)), ("rank", F.col("rank")), ("years", F.col("years")))])
    found = one.select(F.explode(pairs).alias("p")).select("p.key", "p.value")
    issued = t["enso_winter"].where(F.col("winter") == cfg.outlook.winter).select(F.lit("predictor").alias("key"), F.round("predictor", 2).cast("string").alias("value"))
    return found.unionByName(issued)


def payload(tables: dict[str, DataFrame]) -> str:
    """Small result tables as JSON for a page: lists of rows by table, with `</` escaped."""
    rows = {name: [r.asDict(recursive=True) for r in frame.collect()] for name, frame in tables.items()}
    return json.dumps(rows, default=str, allow_nan=False).replace("</", "<\\/")
