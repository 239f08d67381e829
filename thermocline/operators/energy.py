"""The sales model and its hindcasts: log daily sales on degree days, by unit and target winter.

A target is the December year of a winter. Everything a target's forecast may know is keyed by
(unit, target), so all targets are one plan.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermocline.operators import mining as N
from thermocline.operators import models as D
from thermocline.operators import relational as R
from thermocline.operators import stats as S
from thermocline.session import written

KEYS = ["unit", "target"]
LEAST_MONTHS, LEAST_ERRORS = 36, 3


def winter(year: Column, month: Column) -> Column:
    """The December year of a winter's month."""
    return year - (month < 7).cast("int")


def daily(sales: DataFrame, climate: DataFrame) -> DataFrame:
    """unit, year, month, y (log daily sales), h and c (degree days a day): a panel of all months of either table, without gaps."""
    one = sales.select("unit", "year", "month", F.ln(F.when(F.col("sales_mwh") > 0, F.col("sales_mwh")) / F.col("days")).alias("y"))
    two = climate.select("unit", "year", "month", F.try_divide("hdd", "days").alias("h"), F.try_divide("cdd", "days").alias("c"))
    return R.panel(two.join(one, ["unit", "year", "month"], "full"), ["unit"], ["y", "h", "c"]).drop("at", "known")


def by_target(rows: DataFrame, targets: list[int], half: int) -> DataFrame:
    """rows for each target, with hn and cn: normals from the years before it, the month's own left out."""
    each = rows.withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    normal = lambda v: R.leave_one_out_normal(v, [*KEYS, "month"], "year", half, known=F.col("target") - 1)
    return each.withColumn("hn", normal("h")).withColumn("cn", normal("c"))


def billed(rows: DataFrame, weights: list[float]) -> DataFrame:
    """rows by billing weight (w): h, c, hn, cn blended with the month before; rows are a panel, so an unknown month before gives null."""
    order = ["year", "month"]
    lagged = Window.partitionBy(*KEYS).orderBy(*order)
    named = ("h", "c", "hn", "cn")
    before = rows.select("*", *[F.lag(v).over(lagged).alias(f"{v}_before") for v in named])
    each = before.withColumn("w", F.explode(F.array(*map(F.lit, weights))))
    return each.select(*KEYS, *order, "y", "w", *[(F.col("w") * F.col(f"{v}_before") + (1 - F.col("w")) * F.col(v)).alias(v) for v in named])


def training(rows: DataFrame, years: int, through: int) -> DataFrame:
    """What a target's fit may use: its last `years` years up to a month, all billing weights known."""
    t, y = F.col("target"), F.col("year")
    known = (y > t - years) & ((y < t) | ((y == t) & (F.col("month") <= through)))
    whole = F.col("y").isNotNull() & (F.count_if(F.col("h").isNull()).over(Window.partitionBy(*KEYS, "year", "month")) == 0)
    return rows.withColumn("__whole", whole).where(known & F.col("__whole")).drop("__whole")


def fits(rows: DataFrame, weights: list[float], lags: int = 0) -> DataFrame:
    """Of every (unit, target) with LEAST_MONTHS months: w, heating, cooling and their errors, r2, sse, n, level by year, season by month."""
    fields = ["w", "heating", "heating_se", "cooling", "cooling_se", "r2", "sse"]

    def fit(g, rng):
        wide = g.pivot(index=["year", "month"], columns="w", values=["h", "c"])
        wide.columns = [f"{v}{weights.index(w)}" for v, w in wide.columns]
        wide = wide.join(g.groupby(["year", "month"])["y"].first()).reset_index()
        got = D.load_fit(wide, "y", {w: (f"h{k}", f"c{k}") for k, w in enumerate(weights)}, lags, LEAST_MONTHS)
        if got is None:
            return []
        got["w"] = got["billing_weight"]
        return {k: float(got[k]) for k in fields} | {"n": int(got["n"]), "level": {int(k): float(v) for k, v in got["level"].items()}, "season": [float(v) for v in got["season"]]}

    schema = "unit string, target int, " + ", ".join(f"{k} double" for k in fields) + ", n long, level map<int,double>, season array<double>"
    return S.grouped(rows.select(*KEYS, "year", "month", "w", "y", "h", "c"), KEYS, schema, fit, order=["year", "month", "w"])


def coefficients(found: DataFrame) -> DataFrame:
    """The fits in per cent of sales a degree day."""
    return found.select(*KEYS, F.col("w").alias("billing_weight"), *[(100 * F.col(k)).alias(name) for k, name in (("heating", "heating_pct_per_hdd"), ("heating_se", "heating_se"), ("cooling", "cooling_pct_per_cdd"), ("cooling_se", "cooling_se"))], "r2", F.col("n").alias("months"))


def winters_of(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Winter months with their target's fit, at its billing weight, and `winter`."""
    own = rows.where(F.col("month").isin(12, 1, 2)).withColumn("winter", winter(F.col("year"), F.col("month")))
    return own.join(found, [*KEYS, "w"])


def anomaly(rows: DataFrame, level: Column, h: str = "h", c: str = "c") -> DataFrame:
    """unit, target, winter, anomaly: mean excess of log sales over the fit at a year's level, in per cent; whole winters only."""
    expected = F.element_at("level", level.cast("int")) + F.element_at("season", F.col("month").cast("int")) + F.col("heating") * F.col(h) + F.col("cooling") * F.col(c)
    return R.complete_mean(rows.withColumn("__e", 100 * (F.col("y") - expected)), [*KEYS, "winter"], "__e", 3).withColumnRenamed("mean", "anomaly")


def calibration(rows: DataFrame, found: DataFrame, years: int) -> DataFrame:
    """unit, target, shift, sigma: mean and deviation of the fit's anomalies in winters that it knows; the residual's where there are few."""
    past = rows.where((F.col("winter") < F.col("target")) & (F.col("winter") >= F.col("target") - years) & F.map_contains_key("level", F.col("winter").cast("int")) & F.map_contains_key("level", (F.col("winter") + 1).cast("int")))
    errors = anomaly(past, F.col("winter")).groupBy(*KEYS).agg(F.avg("anomaly").alias("m"), F.stddev("anomaly").alias("s"), F.count("anomaly").alias("k"))
    enough = F.coalesce(F.col("k"), F.lit(0)) >= LEAST_ERRORS
    few = 100 * F.sqrt(F.col("sse") / F.greatest(F.col("n") - 1, F.lit(1)))
    return found.join(errors, KEYS, "left").select(*KEYS, F.when(enough, F.col("m")).otherwise(0.0).alias("shift"), F.when(enough, F.col("s")).otherwise(few).alias("sigma"))


def effects(rows: DataFrame) -> DataFrame:
    """unit, target, winter, effect: what a winter's departure from the normals known at the target does to sales, in per cent."""
    moved = F.col("heating") * (F.col("h") - F.col("hn")) + F.col("cooling") * (F.col("c") - F.col("cn"))
    return R.complete_mean(rows.withColumn("__m", 100 * moved), [*KEYS, "winter"], "__m", 3).withColumnRenamed("mean", "effect")


def trajectories(index: DataFrame, first: int, last: int) -> DataFrame:
    """winter, a: the index (year, month, x) from month `first` to `last` of each year that has them all."""
    own = index.where(F.col("month").between(first, last) & F.col("x").isNotNull()).groupBy(F.col("year").alias("winter"))
    path = own.agg(F.array_sort(F.collect_list(F.struct("month", "x"))).alias("p")).where(F.size("p") == last - first + 1)
    return path.select("winter", F.transform("p", lambda v: v["x"]).alias("a"))


def trajectory_distances(index: DataFrame, targets: list[int], first: int, last: int, band: int) -> DataFrame:
    """target, winter, d: time warping distances of the targets' trajectories to all earlier ones. A year is a row: a dimension."""
    paths = trajectories(index, first, last)
    asked = paths.where(F.col("winter").isin(targets)).select(F.col("winter").alias("target"), F.col("a").alias("b"))
    pairs = R.in_blocks(paths, asked, "target").where("winter < target")
    return pairs.select("target", "winter", F.round(N.warping(band)("a", "b"), 9).alias("d"))


def members(history: DataFrame, predictor: DataFrame, value: str, bandwidth: float, least: float, gate: float, analogs: int, distance: DataFrame | None = None) -> DataFrame:
    """unit, target, method, winter, value, x, x0, weight: the earlier winters that make up each method's forecast.

    history holds (unit, target, winter, value), predictor (winter, x). climatology weighs all alike,
    enso by a kernel around the target's x0, analog the nearest by `distance` (target, winter, d), or
    by x without one, gated is enso from |x0| >= gate on and else climatology. linear has the members
    of climatology.
    """
    x0 = predictor.select(F.col("winter").alias("target"), F.col("x").alias("x0"))
    rows = history.where(F.col("winter") < F.col("target")).where(F.col(value).isNotNull()).join(predictor, "winter").join(x0, "target").select(*KEYS, "winter", F.col(value).alias("value"), "x", "x0")
    rows = rows.join(distance, ["target", "winter"], "left") if distance is not None else rows.withColumn("d", F.abs(F.col("x") - F.col("x0")))
    kernel = S.kernel_weights(rows, [*KEYS, "x0"], "x", F.col("x0"), bandwidth, least).withColumnRenamed("w", "kernel").drop("h", "ess")
    near = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("d").asc_nulls_last(), "winter")) <= analogs
    each = kernel.withColumn("near", near & F.col("d").isNotNull())
    weight = {
        "climatology": F.lit(1.0),
        "enso": F.col("kernel"),
        "analog": F.col("near").cast("double"),
        "linear": F.lit(1.0),
        "gated": F.when(F.abs("x0") >= gate, F.col("kernel")).otherwise(1.0),
    }
    made = [each.select(*KEYS, F.lit(m).alias("method"), "winter", "value", "x", "x0", w.alias("weight")) for m, w in weight.items()]
    return reduce(DataFrame.unionByName, made).where("weight > 0")


def forecasts(rows: DataFrame, observed: DataFrame, spread: DataFrame | None = None, interval: float = 0.8) -> DataFrame:
    """unit, target, method with mean, lo, median, hi, prob_above, observed, crps, pit, covered.

    observed holds (unit, target, observed), spread (unit, target, shift, sigma) of the sales model.
    linear is one normal around the regression on x; the others are mixtures of their members.
    """
    both = rows.join(observed.where(F.col("observed").isNotNull()), KEYS)
    both = both.join(spread, KEYS) if spread is not None else both.withColumn("shift", F.lit(0.0)).withColumn("sigma", F.lit(0.0))
    names = ("mean", "lo", "median", "hi", "prob_above", "observed", "crps", "pit")

    def one(g, rng):
        value, w, sigma = g["value"].to_numpy(), g["weight"].to_numpy(), float(g["sigma"].iloc[0])
        if g["method"].iloc[0] == "linear":
            if len(g) < 3 or np.ptp(g["x"]) == 0:
                return []
            mean, sigma = D.linear_forecast(g["x"].to_numpy(), value, float(g["x0"].iloc[0]), sigma)
            value, w = np.array([mean]), np.ones(1)
        got = D.summary(value + float(g["shift"].iloc[0]), w, sigma, float(g["observed"].iloc[0]), interval)
        return {k: float(got[k]) for k in names} | {"covered": got["covered"]}

    keys = [*KEYS, "method"]
    named = both.withColumn("__m", F.col("method"))
    return S.grouped(named.select(*KEYS, F.col("__m").alias("method"), "winter", "value", "x", "x0", "weight", "shift", "sigma", "observed"), keys, "unit string, target int, method string, " + ", ".join(f"{k} double" for k in names) + ", covered boolean", one, order=["winter"])


def outlooks(rows: DataFrame, spread: DataFrame | None = None, interval: float = 0.8) -> DataFrame:
    """unit, target, method, mean, lo, median, hi, prob_above, ess: forecasts() of winters that are not over."""
    both = rows.join(spread, KEYS) if spread is not None else rows.withColumn("shift", F.lit(0.0)).withColumn("sigma", F.lit(0.0))
    names = ("mean", "lo", "median", "hi", "prob_above")

    def one(g, rng):
        value, w, sigma = g["value"].to_numpy(), g["weight"].to_numpy(), float(g["sigma"].iloc[0])
        ess = float(w.sum() ** 2 / (w**2).sum())
        if g["m"].iloc[0] == "linear":
            if len(g) < 3 or np.ptp(g["x"]) == 0:
                return []
            mean, sigma = D.linear_forecast(g["x"].to_numpy(), value, float(g["x0"].iloc[0]), sigma)
            value, w = np.array([mean]), np.ones(1)
        got = D.summary(value + float(g["shift"].iloc[0]), w, sigma, None, interval)
        return {k: float(got[k]) for k in names} | {"ess": ess}

    schema = "unit string, target int, method string, " + ", ".join(f"{k} double" for k in (*names, "ess"))
    return S.grouped(both.select(*KEYS, "method", F.col("method").alias("m"), "winter", "value", "x", "x0", "weight", "shift", "sigma"), [*KEYS, "method"], schema, one, order=["winter"])


def sales_hindcasts(sales: DataFrame, climate: DataFrame, predictor: DataFrame, targets: list[int], weights: list[float], half: int, years: int, through: int, bandwidth: float, least: float, gate: float, analogs: int, interval: float = 0.8, distance: DataFrame | None = None, lags: int = 0) -> DataFrame:
    """Hindcasts of winter sales anomalies by every method and by the weather that came (perfect_weather)."""
    rows = billed(by_target(daily(sales, climate), targets, half), weights)
    found = fits(training(rows, years, through), weights, lags)
    cold = winters_of(rows, found)
    spread = calibration(cold, found, years)
    seen = anomaly(cold.where("winter = target"), F.col("target"), "hn", "cn").select(*KEYS, F.col("anomaly").alias("observed"))
    moved = effects(cold)
    perfect = moved.where("winter = target").select(*KEYS, F.lit("perfect_weather").alias("method"), "winter", F.col("effect").alias("value"), F.lit(0.0).alias("x"), F.lit(0.0).alias("x0"), F.lit(1.0).alias("weight"))
    made = members(moved, predictor, "effect", bandwidth, least, gate, analogs, distance).unionByName(perfect.where("value is not null"))
    return forecasts(made, seen, spread, interval).join(found.select(*KEYS, F.col("w").alias("billing_weight")), KEYS)


def percent_of_normal(rows: DataFrame) -> DataFrame:
    """unit, target, winter, value: a winter's degree days in per cent of the normals known at the target; null where a month is missing."""
    cold = rows.where(F.col("month").isin(12, 1, 2)).withColumn("winter", winter(F.col("year"), F.col("month")))
    return cold.groupBy(*KEYS, "winter").agg(F.when(F.count(F.col("h") - F.col("hn")) == 3, 100 * F.try_divide(F.sum(F.col("h") - F.col("hn")), F.sum("hn"))).alias("value"))


def climate_hindcasts(climate: DataFrame, predictor: DataFrame, targets: list[int], half: int, bandwidth: float, least: float, gate: float, analogs: int, interval: float = 0.8, distance: DataFrame | None = None) -> DataFrame:
    """Hindcasts of winter degree days in per cent of the normals known at the target."""
    rows = by_target(climate.select("unit", "year", "month", F.col("hdd").alias("h"), F.col("cdd").alias("c")), targets, half)
    percent = percent_of_normal(rows)
    seen = percent.where("winter = target").select(*KEYS, F.col("value").alias("observed"))
    return forecasts(members(percent, predictor, "value", bandwidth, least, gate, analogs, distance), seen, None, interval)


def scores(rows: DataFrame, predictor: DataFrame, threshold: float, gate: float, replicates: int, seed: int = 0) -> DataFrame:
    """level, unit, subset, method, winters, crps, crpss, crpss_lo, crpss_hi, coverage.

    rows holds hindcasts (level, unit, target, method, crps, covered). A target belongs to `all` and to
    the subsets that its predictor at issue says. Skill is against climatology over the method's own
    targets; its limits (90 %) are those of a paired bootstrap over targets.
    """
    x = F.col("x")
    labels = F.array_compact(F.array(F.lit("all"), F.when(x >= threshold, "el_nino_at_issue"), F.when(x >= gate, "strong_el_nino_at_issue"), F.when(x <= -threshold, "la_nina_at_issue"), F.when(F.abs(x) < threshold, "neutral_at_issue")))
    signal = predictor.select(F.col("winter").alias("target"), "x")
    rows = written(rows.select("level", "unit", "target", "method", "crps", "covered"), "hindcasts")
    base = rows.where("method = 'climatology'").select("level", "unit", "target", F.col("crps").alias("base"))
    each = written(rows.join(signal, "target").join(base, ["level", "unit", "target"]).withColumn("subset", F.explode(labels)), "scored")
    keys = ["level", "unit", "subset", "method"]
    means = each.groupBy(*keys).agg(F.count("*").alias("winters"), F.avg("crps").alias("crps"), S.skill(F.avg("crps"), F.avg("base")).alias("crpss"), F.avg(F.col("covered").cast("int")).alias("coverage"))
    limits = S.bootstrap(each, keys, F.col("crps"), F.col("base"), ["target"], replicates, seed=seed)
    return means.join(limits, keys, "left").select(*keys, "winters", "crps", "crpss", (1 - F.col("hi")).alias("crpss_lo"), (1 - F.col("lo")).alias("crpss_hi"), "coverage")
