"""From parsed tables to the gold tables: hierarchy, unit climate and sales, prices, the spliced index."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.config import Config
from thermocline.functions.columns import base_period
from thermocline.operators import relational as R
from thermocline.sources.text import with_dates

CLIMATE = ("tmp", "hdd", "cdd", "pcpn")


def states(spark: SparkSession, cfg: Config, retail: DataFrame) -> DataFrame:
    """state, region, climate_state, weight: the share of residential sales over the weight years."""
    first, last = cfg.climate.weight_years
    rows = [(s, region, cfg.climate.dc_climate_state if s == "DC" else s) for region, own in cfg.regions.items() for s in own]
    table = spark.createDataFrame(rows, "state string, region string, climate_state string")
    sold = retail.where((F.col("sector") == "residential") & F.col("year").between(first, last)).groupBy("state").agg(F.sum("sales_mwh").alias("amount"))
    joined = table.join(F.broadcast(sold), "state", "left").withColumn("amount", F.coalesce("amount", F.lit(0.0)))
    total = joined.agg(F.sum("amount").alias("total"))
    return joined.crossJoin(F.broadcast(total)).select("state", "region", "climate_state", F.try_divide("amount", "total").alias("weight"))


def unit_members(state: DataFrame) -> DataFrame:
    return R.members(state, "state", "region", "US").withColumnRenamed("member", "state")


def unit_climate(climate: DataFrame, state: DataFrame, member: DataFrame) -> DataFrame:
    """Weighted means of the climate variables by unit and month; a state's own rows weigh 1."""
    linked = member.join(F.broadcast(state.select("state", "climate_state", "weight")), "state").withColumn("weight", F.when(F.col("kind") == "state", 1.0).otherwise(F.col("weight")))
    rows = climate.withColumnRenamed("state", "climate_state").join(F.broadcast(linked.drop("state")), "climate_state")
    means = [R.weighted_mean(F.col(c), F.col("weight")).alias(c) for c in CLIMATE]
    return with_dates(rows.groupBy("unit", "kind", "year", "month").agg(*means))


def unit_sales(retail: DataFrame, member: DataFrame) -> DataFrame:
    """Sums by unit, sector and month, null only where all are; price from revenue and sales."""
    rows = R.fan_out(retail, member.withColumnRenamed("state", "member"), "state")
    sums = [F.sum(c).alias(c) for c in ("sales_mwh", "revenue_k", "customers")]
    got = rows.groupBy("unit", "kind", "sector", "year", "month").agg(*sums)
    return with_dates(got.withColumn("price_cents", 100 * F.try_divide("revenue_k", "sales_mwh")))


def gas_month(gas_day: DataFrame) -> DataFrame:
    rows = gas_day.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(F.avg("henry_hub").alias("henry_hub"), F.count("*").alias("trading_days"))
    return with_dates(rows).drop("days")


def price_month(price_day: DataFrame, gas: DataFrame, least: int) -> DataFrame:
    """Mean price of a hub's months with enough trading days, beside the gas price and their ratio."""
    rows = price_day.groupBy("hub", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.avg("price").alias("price"), F.count("price").alias("trading_days")).where(F.col("trading_days") >= least)
    both = rows.join(F.broadcast(gas.select("year", "month", "henry_hub")), ["year", "month"], "left")
    return with_dates(both.withColumn("heat_rate", F.try_divide("price", "henry_hub"))).drop("days")


def sliding_anomaly(monthly: DataFrame, value: str, window: int, step: int, anchor: int) -> DataFrame:
    """date, anomaly: value minus its calendar month's mean over the base period of its year.

    Base periods lie between the first complete year and the last full decade's end.
    """
    rows = monthly.where(F.col(value).isNotNull()).select("date", F.year("date").alias("y"), F.month("date").alias("m"), F.col(value).alias("v"))
    whole = rows.groupBy("y").count().where("count = 12").agg(F.min("y"), F.max("y")).first()
    if whole[0] is None:
        return rows.select("date", F.lit(None).cast("double").alias("anomaly"))
    period = base_period(F.col("y"), whole[0], whole[1] // 10 * 10, window, step, anchor)
    periods = rows.select("y").distinct().select("y", period.alias("p")).select(F.col("y").alias("of"), "p.start", "p.end")
    mean = rows.join(F.broadcast(periods), F.col("y").between(F.col("start"), F.col("end"))).groupBy("of", "m").agg(F.avg("v").alias("mean"))
    return rows.join(mean, (rows["y"] == mean["of"]) & (rows["m"] == mean["m"]), "left").select("date", (F.col("v") - F.col("mean")).alias("anomaly"))


def harmonised(season: DataFrame, long: DataFrame, window: int = 30, step: int = 5, anchor: int = 1956) -> tuple[DataFrame, DataFrame]:
    """(index by month with its source, the calibration): the direct index where it is, the calibrated long one elsewhere."""
    smooth = sliding_anomaly(long, "nino34", window, step, anchor)
    smooth = smooth.withColumn("long", R.centred_mean("anomaly", [], "date")).select("date", "long")
    both = season.select("date", "roni").join(smooth, "date", "full")
    fit = both.agg(F.regr_slope("roni", "long").alias("slope"), F.regr_intercept("roni", "long").alias("intercept"), F.corr("roni", "long").alias("r"), F.regr_count("roni", "long").alias("n"), F.min(F.when(F.col("roni").isNotNull() & F.col("long").isNotNull(), F.col("date"))).alias("first"), F.max(F.when(F.col("roni").isNotNull() & F.col("long").isNotNull(), F.col("date"))).alias("last"))
    rows = both.crossJoin(F.broadcast(fit.select("slope", "intercept"))).withColumn("calibrated", F.col("intercept") + F.col("slope") * F.col("long"))
    error = rows.agg(F.sqrt(F.avg(F.pow(F.col("roni") - F.col("calibrated"), 2))).alias("rmse"))
    index = rows.select("date", "roni", "long", "calibrated", F.coalesce("roni", "calibrated").alias("index"), F.when(F.col("roni").isNull(), "calibrated").otherwise("roni").alias("source")).where(F.col("index").isNotNull())
    return index, fit.crossJoin(error)


POINTER = "CURRENT"


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, folder: str) -> dict[str, str]:
    """The paths of the saved tables by name: what the pointer file of the folder says."""
    path, files = _files(spark, folder)
    if not files.exists(path(f"{folder}/{POINTER}")):
        return {}
    rows = spark.read.text(f"{folder}/{POINTER}", wholetext=True).collect()
    return json.loads(rows[0][0])


def save(tables: dict[str, DataFrame], folder: str, add: bool = False) -> None:
    """All tables as Parquet in a new version of the folder; then one rename makes them the current ones.

    Readers see all tables of one version or all of the next. With add the other current tables stay;
    versions that the pointer no longer names are deleted afterwards.
    """
    spark = next(iter(tables.values())).sparkSession
    path, files = _files(spark, folder)
    before = current(spark, folder)
    version = f"{folder}/v-{uuid.uuid4().hex[:12]}"
    for name, rows in tables.items():
        rows.write.parquet(f"{version}/{name}")
    now = (before if add else {}) | {name: f"{version}/{name}" for name in tables}
    beside = path(f"{folder}/.{POINTER}-{uuid.uuid4().hex[:12]}")
    jvm = spark.sparkContext._jvm
    out = files.create(beside, True)
    out.write(bytearray(json.dumps(now, sort_keys=True).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(beside), files.makeQualified(path(f"{folder}/{POINTER}")), options)
    for old in set(before.values()) - set(now.values()):
        files.delete(path(old), True)


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The current tables by name."""
    return {name: spark.read.parquet(place) for name, place in sorted(current(spark, folder).items())}


def read(spark: SparkSession, folder: str, sql: str, **values: object) -> DataFrame:
    """A SQL text over saved tables, with named parameters."""
    for name, rows in tables(spark, folder).items():
        rows.createOrReplaceTempView(name)
    return spark.sql(sql, args=values or None)
