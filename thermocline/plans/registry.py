"""Registration of queries with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.operators import relational as R
from thermocline.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Tables under its name, with its SQL if SQL can say it."""

    def add(function: Callable[[Tables], DataFrame]):
        key = name or function.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return function(Tables(spark, folder))

        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return function

    return add


#: Amounts are summed in whole cents, so that sums do not depend on their order.
CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
MONTHLY = f"""monthly AS (
  SELECT n_name AS nation, r_name AS region, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum({CENTS}) / 100.0::DOUBLE AS v, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""
MEMBER = """member AS (SELECT n_name AS unit, 'state' AS kind, n_name AS nation FROM nation
  UNION ALL SELECT r_name, 'region', n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'WORLD', 'nation', n_name FROM nation)"""
UNITS = MONTHLY + ", " + MEMBER + """, units AS (SELECT unit, kind, month, CAST(round(sum(v) * 100) AS BIGINT) / 100.0::DOUBLE AS v, sum(n) AS n FROM monthly JOIN member USING (nation) GROUP BY ALL)"""
TOTAL = f"""total AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum({CENTS}) / 100.0::DOUBLE AS v, count(*) AS n FROM orders GROUP BY ALL)"""


def cents(amount: str):
    return F.round(F.col(amount) * 100).cast("long")


def nations(t: Tables) -> DataFrame:
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def monthly(t: Tables) -> DataFrame:
    """nation, region, month, v (order value), n (orders)."""
    buyers = t.customer.select("c_custkey", "c_nationkey").join(F.broadcast(nations(t)), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = t.orders.select("o_custkey", "o_orderdate", "o_totalprice").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("nation", "region", F.trunc("o_orderdate", "month").alias("month")).agg((F.sum(cents("o_totalprice")) / F.lit(100.0)).alias("v"), F.count("*").alias("n"))


def member(t: Tables) -> DataFrame:
    return R.members(nations(t), "nation", "region", "WORLD")


def units(t: Tables) -> DataFrame:
    """unit, kind, month, v, n of nations, regions and the world."""
    rows = R.fan_out(monthly(t), member(t), "nation")
    return rows.groupBy("unit", "kind", "month").agg((F.round(F.sum("v") * 100).cast("long") / F.lit(100.0)).alias("v"), F.sum("n").alias("n"))


def total(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg((F.sum(cents("o_totalprice")) / F.lit(100.0)).alias("v"), F.count("*").alias("n"))
