"""Season data of many units against an index: correlations, composites by phase, teleconnections, cluster features.

Climate tables are long: variable, unit, year, month, value. The index is year, month, x.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.operators import relational as R
from thermocline.operators import stats as S

#: Seasons of three months; the first begins in December and is named by the year of its January.
NAMES = ("DJF", "MAM", "JJA", "SON")
PHASES = ("el_nino", "la_nina", "super")


def season_number(month: Column) -> Column:
    return F.floor((month % 12) / 3).cast("int")


def anomalies(rows: DataFrame, half: int) -> DataFrame:
    """rows with normal (leave-one-out mean of the calendar month within `half` years) and anomaly, over a panel of each series."""
    whole = R.panel(rows, ["variable", "unit"], ["value"]).drop("at", "known")
    normal = R.leave_one_out_normal("value", ["variable", "unit", "month"], "year", half)
    return whole.withColumn("normal", normal).withColumn("anomaly", F.col("value") - F.col("normal"))


def complete_years(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of the (keys, year) in which every unit that the keys' variable has anywhere is known."""
    known = rows.where(F.col(value).isNotNull())
    units = rows.groupBy("variable").agg(F.count_distinct("unit").alias("__units"))
    whole = known.groupBy(*keys, "year").agg(F.count_distinct("unit").alias("__n")).join(units, "variable").where("__n = __units")
    return known.join(whole.drop("__n", "__units"), [*keys, "year"])


def season_data(rows: DataFrame, index: DataFrame, half: int) -> DataFrame:
    """variable, season, year, unit, x, value: season means of anomalies and the index in the season's middle month.

    Only whole seasons, and of these only years with an index in which every unit of the variable has
    one, so that all units are compared over the same years.
    """
    k = season_number(F.col("month"))
    named = anomalies(rows, half).select("variable", "unit", F.element_at(F.array(*map(F.lit, NAMES)), k + 1).alias("season"), (F.col("year") + (F.col("month") == 12).cast("int")).alias("year"), "anomaly")
    mean = R.complete_mean(named, ["variable", "unit", "season", "year"], "anomaly", 3).withColumnRenamed("mean", "value")
    middle = index.where((F.col("month") % 3 == 1) & F.col("x").isNotNull()).select("year", F.element_at(F.array(*map(F.lit, NAMES)), season_number(F.col("month")) + 1).alias("season"), "x")
    return complete_years(mean, ["variable", "season"], "value").join(middle, ["season", "year"]).select("variable", "season", "year", "unit", "x", "value")


def composites(data: DataFrame, threshold: float, strong: float, keys: Sequence[str] = ("variable", "season", "unit")) -> DataFrame:
    """keys, n, r (rank correlation), slope, and the number and mean of years by phase of the index."""
    keys = list(keys)
    x = F.col("x")
    own = {"el_nino": x >= threshold, "la_nina": x <= -threshold, "super": x >= strong}
    sums = data.groupBy(*keys).agg(F.regr_slope("value", "x").alias("slope"), *[c for p in PHASES for c in (F.count_if(own[p]).alias(f"{p}_n"), F.avg(F.when(own[p], F.col("value"))).alias(f"{p}_mean"))])
    return S.spearman(data, keys, "x", "value").join(sums, keys)


def surrogate_p(data: DataFrame, keys: list[str], count: int, seed: int) -> DataFrame:
    """keys, p of the rank correlation of x and value by phase-randomised surrogates of x, a group a series."""

    def test(g, rng):
        if len(g) < 4:
            return []
        _, p = S.field_test(g["x"].to_numpy(), g[["value"]].to_numpy(), count, rng)
        return {"p": float(p[0])}

    kinds = ", ".join(f"{k} {data.schema[k].dataType.simpleString()}" for k in keys)
    return S.grouped(data.select(*keys, "year", "x", "value"), keys, f"{kinds}, p double", test, seed=seed, order=["year"])


def fingerprint(data: DataFrame, field: Column, threshold: float, strong: float, surrogates: int, replicates: int, method: str = "bh", q: float = 0.1, seed: int = 0) -> DataFrame:
    """composites() of season data with p, limits of the phase means (90 %) and q in two families.

    The units of the field (a condition on unit) are one family, all others the other. Limits come
    from one pass of Poisson bootstrap weights; a phase of fewer than two years has none.
    """
    keys = ["variable", "season", "unit"]
    found = composites(data, threshold, strong).join(surrogate_p(data, keys, surrogates, seed), keys, "left")
    x = F.col("x")
    phases = F.array_compact(F.array(F.when(x >= threshold, "el_nino"), F.when(x <= -threshold, "la_nina"), F.when(x >= strong, "super")))
    limits = S.bootstrap(data.withColumn("phase", F.explode(phases)), [*keys, "phase"], F.col("value"), F.lit(1.0), ["year"], replicates, seed=seed)
    wide = limits.groupBy(*keys).pivot("phase", list(PHASES)).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    tested = S.with_q(found.join(wide, keys, "left").withColumn("in_field", field), "p", ["in_field"], method)
    return tested.withColumn("significant", F.col("q") <= q)


def teleconnections(rows: DataFrame, index: DataFrame, half: int, leads: int, surrogates: int, method: str = "bh", q: float = 0.1, seed: int = 0) -> DataFrame:
    """variable, unit, month, lead, n, r, slope, p, q, significant of every calendar month's anomalies and the index `lead` months before.

    All tests are one family. A month's years are those in which the index and all units of the
    variable are known. Each series is a group of its own.
    """
    keys = ["variable", "unit", "month", "lead"]
    known = complete_years(anomalies(rows, half).select("variable", "unit", "year", "month", "anomaly"), ["variable", "month"], "anomaly")
    then = index.where(F.col("x").isNotNull()).select((F.col("year") * 12 + F.col("month")).alias("at"), "x")
    each = known.withColumn("lead", F.explode(F.sequence(F.lit(0), F.lit(leads)))).withColumn("at", F.col("year") * 12 + F.col("month") - F.col("lead"))
    data = each.join(then, "at").select(*keys, "year", "x", F.col("anomaly").alias("value"))
    slope = data.groupBy(*keys).agg(F.regr_slope("value", "x").alias("slope"))
    found = S.spearman(data, keys, "x", "value").join(slope, keys).join(surrogate_p(data, keys, surrogates, seed), keys)
    return S.with_q(found, "p", None, method).withColumn("significant", F.col("q") <= q)


def summary(found: DataFrame, q: float) -> DataFrame:
    """variable, lead, tests, discoveries, expected_false, uncorrected_p05."""
    hits = F.count_if("significant")
    return found.groupBy("variable", "lead").agg(F.count("*").alias("tests"), hits.alias("discoveries"), F.round(hits * q, 1).alias("expected_false"), F.count_if(F.col("p") <= 0.05).alias("uncorrected_p05"))


def winter_percent(rows: DataFrame, half: int, months: Sequence[int] = (12, 1, 2)) -> DataFrame:
    """variable, unit, winter, pct: the months' sum in per cent of its normal, by the year of December; whole winters only."""
    own = anomalies(rows, half).where(F.col("month").isin(list(months))).withColumn("winter", F.col("year") - (F.col("month") < 7).cast("int"))
    sums = own.groupBy("variable", "unit", "winter").agg(F.count("anomaly").alias("n"), F.try_divide(100 * F.sum("anomaly"), F.sum("normal")).alias("pct"))
    return sums.where(F.col("n") == len(months)).drop("n")


def features(data: DataFrame) -> DataFrame:
    """unit, feature (variable_season), r: what units are clustered by."""
    found = S.spearman(data, ["variable", "season", "unit"], "x", "value")
    return found.select("unit", F.concat_ws("_", "variable", "season").alias("feature"), "r")


def drawn_years(data: DataFrame, replicates: int, seed: int) -> DataFrame:
    """season data for each replicate (rep): 0 as it is, others with years drawn with replacement (times).

    Every place of a replicate takes a year by its number's digest; all series of a replicate take the same years.
    """
    common = data.select("variable", "season", "year").distinct().groupBy("year").agg(F.count("*").alias("n"))
    series = data.select("variable", "season").distinct().agg(F.count("*").alias("all"))
    years = common.join(F.broadcast(series), F.col("n") == F.col("all")).agg(F.array_sort(F.collect_list("year")).alias("years"))  # a row a year: a dimension
    spots = years.select("years", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).select("years", "rep", F.explode(F.sequence(F.lit(1), F.size("years"))).alias("place"))
    pick = F.pmod(F.xxhash64("rep", "place", F.lit(seed)), F.size("years")).cast("int") + 1
    times = spots.select("rep", F.element_at("years", pick).alias("year")).groupBy("rep", "year").agg(F.count("*").alias("times"))
    return data.join(times, "year").unionByName(data.withColumn("rep", F.lit(0)).withColumn("times", F.lit(1).cast("long")))


def feature_matrix(g) -> tuple[list[str], np.ndarray]:
    """Units and their rank correlations by variable and season, from season data (with times) as pandas."""
    units, columns = sorted(g["unit"].unique()), []
    for _, own in sorted(g.groupby(["variable", "season"]), key=lambda p: p[0]):
        wide = own.pivot(index="year", columns="unit", values="value").reindex(columns=units)
        x, times = own.groupby("year")["x"].first().loc[wide.index].to_numpy(), own.groupby("year")["times"].first().loc[wide.index].to_numpy()
        again = np.repeat(np.arange(len(x)), times)
        columns.append(S.standard_ranks(x[again]) @ S.standard_ranks(wide.to_numpy()[again]) / len(again))
    return units, np.stack(columns, 1)
