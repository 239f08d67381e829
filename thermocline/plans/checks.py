"""The twenty checks of the gold tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermocline.config import Config
from thermocline.operators import quality as Q
from thermocline.sources.text import STATE_CODES

STATES = sorted([*STATE_CODES.values(), "DC"])


def enso(t: dict[str, DataFrame]) -> list[DataFrame]:
    season = t["enso_season"].where(F.col("roni").isNotNull())
    strong = season.where((F.abs("roni") > 0.5) & (F.abs("oni") > 0.5))
    gaps = t["enso_week"].select(F.datediff("week", F.lag("week").over(Window.orderBy("week"))).alias("gap")).where("gap is not null")
    return [
        Q.no_gaps(season, "date", "roni_continuous"),
        Q.same_sign(strong, "roni", "oni", 0.95, "roni_oni_sign_agreement"),
        Q.check(t["enso_calibration"], F.min("r") >= 0.9, "hadisst_calibration_r", detail=F.round(F.min("r"), 3)),
        Q.check(gaps, F.count_if(F.col("gap") != 7) == 0, "weekly_spacing"),
    ]


def climate(t: dict[str, DataFrame]) -> list[DataFrame]:
    rows = t["climate_month"]
    named = ("tmp", "hdd", "cdd", "pcpn")
    whole = F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in named]) == 1).alias("nulls")
    years = rows.groupBy("year").agg(F.count("*").alias("n"), whole)
    latest = rows.agg(F.max("year").alias("latest"))
    bad = (F.col("year") < F.col("latest")) & (F.col("n") != len(STATE_CODES) * 12)
    sane = F.col("tmp").between(-30, 110) & (F.least("hdd", "cdd", "pcpn") >= 0)
    return [
        Q.check(years.join(F.broadcast(latest)), F.count_if(bad | (F.col("nulls") > 0)) == 0, "climate_complete_years"),
        Q.check(rows, F.count_if(~F.coalesce(sane, F.lit(False))) == 0, "climate_ranges"),
        Q.correlated_below(rows.where("month = 1"), ["state"], "tmp", "hdd", -0.8, "hdd_tracks_temperature"),
    ]


def retail(t: dict[str, DataFrame]) -> list[DataFrame]:
    rows = t["retail_month"]
    homes = rows.where("sector = 'residential'")
    months = homes.groupBy("year", "month").agg(F.count("*").alias("n"))
    price = F.abs(100 * F.try_divide("revenue_k", "sales_mwh") - F.col("price_cents")) < 0.05
    sectors = rows.groupBy("state", "year", "month").pivot("sector", ["residential", "total"]).agg(F.avg("sales_mwh"))
    found = F.size(F.array_intersect(F.collect_set("state"), F.array(*map(F.lit, STATES))))
    return [
        Q.check(homes, found == len(STATES), "retail_states", detail=F.countDistinct("state")),
        Q.check(months, F.min("n") == F.max("n"), "retail_months_complete"),
        Q.mostly(rows, F.coalesce(price, F.lit(False)), 0.999, "retail_price_consistent"),
        Q.mostly(sectors, F.coalesce(F.col("total") + 1e-6 >= F.col("residential"), F.lit(False)), 0.999, "retail_total_ge_residential"),
        Q.check(homes, F.count_if(~F.coalesce(F.col("sales_mwh") > 0, F.lit(False))) == 0, "retail_positive_sales"),
    ]


def prices(t: dict[str, DataFrame]) -> list[DataFrame]:
    day, gas = t["price_day"], t["gas_day"]
    inside = F.col("price").between(F.col("low") - 0.01, F.col("high") + 0.01)
    return [
        Q.mostly(day, F.coalesce(inside, F.lit(False)), 0.999, "wholesale_within_high_low"),
        Q.mostly(day, F.coalesce(F.col("price").between(-100, 5000), F.lit(False)), 1.0, "wholesale_price_range"),
        Q.check(day, F.count_if(F.col("delivery_end") < F.col("date")) == 0, "wholesale_delivery_order", "warn"),
        Q.check(gas, F.count_if(~F.coalesce(F.col("henry_hub").between(0, 50), F.lit(False))) == 0, "henry_hub_range"),
    ]


def joins(t: dict[str, DataFrame]) -> list[DataFrame]:
    states = t["state"]
    return [
        Q.no_orphans(states, t["climate_month"].select("state").distinct(), "climate_state", "state", "state_climate_join"),
        Q.check(states, (F.count("*") == len(STATES)) & (F.size(F.array_intersect(F.collect_set("state"), F.array(*map(F.lit, STATES)))) == len(STATES)), "region_partition"),
        Q.sums_to_one(states, "weight", "weights_sum_to_one"),
    ]


def manifest(t: dict[str, DataFrame], cfg: Config) -> list[DataFrame]:
    """Files placed by hand, without a manifest, are in order."""
    listed = t["source_file"]
    files = listed.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(cfg.path("raw"))).select("path", "content")
    return [Q.files_match(files, listed)]


def all_checks(t: dict[str, DataFrame], cfg: Config) -> DataFrame:
    return Q.run([*enso(t), *climate(t), *retail(t), *prices(t), *joins(t), *manifest(t, cfg)])
