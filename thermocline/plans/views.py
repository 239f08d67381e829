"""View queries over result tables: what the pages of a report select. Each takes tables by name and gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermocline.functions.columns import rounded

Tables = dict[str, DataFrame]


def _rounded(rows: DataFrame, digits: int, *names: str) -> DataFrame:
    return rows.withColumns({n: rounded(F.col(n), digits) for n in names})


def outlook(t: Tables, level: str, method: str, kind: str = "all") -> DataFrame:
    """An outlook's rows of a level and method: all units, the states (two letters, not US), the regions or the nation."""
    is_state = (F.length("unit") == 2) & (F.col("unit") != "US")
    keep = {"all": F.lit(True), "states": is_state, "regions": ~is_state & (F.col("unit") != "US"), "nation": F.col("unit") == "US"}[kind]
    return _rounded(t["outlook"].where((F.col("level") == level) & (F.col("method") == method) & keep), 2, "mean", "lo", "median", "hi", "prob_above").orderBy("unit")


def scenario(t: Tables, unit: str = "US") -> DataFrame:
    """The fan of a unit's scenarios."""
    return t["outlook_scenario"].where(F.col("unit") == unit).select("scenario_djf", "mean", "lo", "median", "hi", "prob_above").orderBy("scenario_djf")


def price_outlook(t: Tables, method: str) -> DataFrame:
    return _rounded(t["outlook_price"].where(F.col("method") == method), 1, "hdd_median", "premium_median", "premium_lo", "premium_hi").orderBy("market")


def analog_outlook(t: Tables) -> DataFrame:
    return _rounded(t["outlook_analog"], 1, "us_hdd_pct").orderBy("winter")


def enso_history(t: Tables) -> DataFrame:
    """The index by month with its sign's phase and its source."""
    v = F.col("index")
    return t["enso_month"].select("date", rounded(v, 2).alias("index"), "source", F.when(v >= 0.5, "el_nino").when(v <= -0.5, "la_nina").otherwise("neutral").alias("phase")).orderBy("date")


def trajectories(t: Tables, years: list[int]) -> DataFrame:
    """The index of some years side by side, a row a month."""
    return t["enso_month"].withColumn("year", F.year("date")).where(F.col("year").isin(years)).groupBy(F.month("date").alias("month")).pivot("year", years).agg(F.first("index")).orderBy("month")


def analog_table(t: Tables) -> DataFrame:
    return _rounded(t["analog"].select("rank", "year", "label", "dtw", "euclidean", "djf", "category"), 2, "dtw", "euclidean", "djf").orderBy("rank")


def top_el_ninos(t: Tables, most: int = 12) -> DataFrame:
    """The strongest warm events."""
    return t["enso_event"].where("phase = 'el_nino'").select("event_id", "first", "last", "peak_at", rounded(F.col("peak"), 2).alias("peak"), "months").orderBy(F.desc("peak"), "first").limit(most)


def fingerprint(t: Tables, variable: str, season: str) -> DataFrame:
    return t["fingerprint"].where((F.col("variable") == variable) & (F.col("season") == season)).orderBy("unit")


def field_counts(t: Tables) -> DataFrame:
    """Discoveries and uncorrected hits by variable."""
    return t["teleconnection"].groupBy("variable").agg(F.count("*").alias("tests"), F.count_if("significant").alias("discoveries"), F.count_if(F.col("p") < 0.05).alias("uncorrected_p05")).orderBy("variable")


def lead_grid(t: Tables, variable: str) -> DataFrame:
    """Discoveries by lead and month."""
    return t["teleconnection"].where(F.col("variable") == variable).groupBy("lead").pivot("month", list(range(1, 13))).agg(F.count_if("significant")).orderBy("lead")


def clusters(t: Tables) -> DataFrame:
    """A cluster's name and its states, sorted."""
    return t["cluster_state"].groupBy("cluster", "name").agg(F.array_join(F.array_sort(F.collect_list("state")), " ").alias("states")).orderBy("cluster")


def rules_table(t: Tables) -> DataFrame:
    return t["rule"].select("antecedent", "consequent", "count", "confidence", "lift", "p", "q", "significant").orderBy(F.desc("significant"), F.desc("lift"), F.desc("count"))


def backtest_methods(t: Tables, level: str) -> DataFrame:
    return t["backtest_score"].where(F.col("level") == level).select("method").distinct().orderBy("method")


def backtest_map(t: Tables, level: str, subset: str, method: str) -> DataFrame:
    """Skill by state."""
    return t["backtest_score"].where((F.col("level") == level) & (F.col("subset") == subset) & (F.col("method") == method) & (F.length("unit") == 2) & (F.col("unit") != "US")).select("unit", rounded(F.col("crpss"), 3).alias("crpss")).orderBy("unit")


def backtest_regions(t: Tables, level: str, subset: str, methods: list[str]) -> DataFrame:
    """Skill by unit and method, methods as columns."""
    rows = t["backtest_score"].where((F.col("level") == level) & (F.col("subset") == subset) & ((F.length("unit") > 2) | (F.col("unit") == "US")))
    return rows.groupBy("unit").pivot("method", methods).agg(rounded(F.first("crpss"), 3)).orderBy("unit")


def gas_premium(t: Tables) -> DataFrame:
    """Winter premiums of the gas market with their phase."""
    return t["price_premium"].where("market = 'gas'").select("winter", "label", rounded(F.col("premium"), 1).alias("premium"), "hdd_pct", "phase").orderBy("winter")


def premium_table(t: Tables) -> DataFrame:
    return _rounded(t["price_premium_summary"].select("market", "region", "winters", "slope_per_hdd_pct", "r", "p"), 3, "slope_per_hdd_pct", "r", "p").orderBy("market")


def hydro(t: Tables, driver: str) -> DataFrame:
    return t["hydro_lag"].where(F.col("driver") == driver).select("month", "winters", "r", "q").orderBy("month")


def quality_table(t: Tables) -> DataFrame:
    """PASS, WARN or FAIL of every check."""
    said = F.when(F.col("passed"), "PASS").when(F.col("severity") == "warn", "WARN").otherwise("FAIL")
    return t["quality"].select("name", said.alias("status"), "detail").orderBy("name")
