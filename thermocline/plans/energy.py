"""Queries on the sales model: fits, hindcasts and their scores. Order values stand for sales, orders for degree days."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from thermocline.functions import columns as C
from thermocline.operators import energy as E
from thermocline.plans.registry import monthly, query, total

WEIGHTS, HALF, YEARS, THROUGH, EARLIER = [0.0, 0.25, 0.5, 0.75], 15, 15, 9, 3
METHODS = dict(bandwidth=0.5, least=2.0, gate=0.5, analogs=2)


def tables(t):
    """(sales, climate, predictor): unit rows by month, and a winter's predictor, November's total in standard units."""
    rows = monthly(t).select(F.col("nation").alias("unit"), F.year("month").alias("year"), F.month("month").alias("month"), C.days_in_month(F.col("month")).alias("days"), "v", "n")
    sales = rows.select("unit", "year", "month", "days", F.col("v").alias("sales_mwh"))
    climate = rows.select("unit", "year", "month", "days", F.col("n").cast("double").alias("hdd"), (F.col("n") % 4).cast("double").alias("cdd"))
    months = total(t).where(F.month("month") == 11).select(F.year("month").alias("winter"), F.col("n").alias("x"))
    all_ = Window.partitionBy()
    return sales, climate, months.select("winter", F.round((F.col("x") - F.avg("x").over(all_)) / F.stddev_pop("x").over(all_), 9).alias("x"))


def targets(predictor) -> list[int]:
    """Every winter with EARLIER winters or more before it. Winters are a dimension: a row a year."""
    return sorted(r["winter"] for r in predictor.select("winter").collect())[EARLIER:]


def distances(t, winters: list[int]):
    """Trajectories are the standardised totals from May to November."""
    index = total(t).select(F.year("month").alias("year"), F.month("month").alias("month"), (F.col("n") / 100.0).alias("x"))
    return E.trajectory_distances(index, winters, 5, 11, 2)


@query()
def sales_fits(t):
    """What a target may know, and its response to degree days by least squared error of the billing weight."""
    sales, climate, predictor = tables(t)
    rows = E.billed(E.by_target(E.daily(sales, climate), targets(predictor), HALF), WEIGHTS)
    return E.coefficients(E.fits(E.training(rows, YEARS, THROUGH), WEIGHTS, 12))


@query()
def sales_hindcasts(t):
    """Forecasts of winter sales anomalies by six methods."""
    sales, climate, predictor = tables(t)
    winters = targets(predictor)
    return E.sales_hindcasts(sales, climate, predictor, winters, WEIGHTS, HALF, YEARS, THROUGH, **METHODS, distance=distances(t, winters))


@query()
def climate_hindcasts(t):
    """Forecasts of winter degree days by five methods."""
    _, climate, predictor = tables(t)
    winters = targets(predictor)
    return E.climate_hindcasts(climate, predictor, winters, HALF, **METHODS, distance=distances(t, winters))


@query()
def hindcast_scores(t):
    """Score, skill with its limits and coverage by level, unit, subset of winters and method."""
    rows = climate_hindcasts(t).withColumn("level", F.lit("climate")).unionByName(sales_hindcasts(t).drop("billing_weight").withColumn("level", F.lit("sales")))
    return E.scores(rows, tables(t)[2], 0.5, 1.0, 500, 11)
