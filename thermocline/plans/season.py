"""Queries on season data, fingerprints, features, panels and drawn prices. Order values and numbers stand for climate, all orders for the index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from thermocline.operators import climate as K
from thermocline.operators import models as D
from thermocline.operators import relational as R
from thermocline.operators import stats as S
from thermocline.plans.registry import MONTHLY, TOTAL, UNITS, monthly, query, total, units

HALF, THRESHOLD, STRONG = 3, 0.5, 1.2
INDEX = TOTAL + ", sd AS (SELECT avg(n) AS a, stddev_pop(n) AS s FROM total), ix AS (SELECT year(month)::BIGINT AS year, month(month) AS mo, round((n - a) / s, 6) AS x FROM total, sd)"
SEASONS = "WITH " + UNITS + ", " + INDEX + """, lo AS (SELECT 'value' AS variable, unit, kind, month, round(v / 1000) AS val FROM units UNION ALL SELECT 'orders', unit, kind, month, n::DOUBLE FROM units),
an AS (SELECT variable, unit, kind, month, val - avg(val) OVER (PARTITION BY variable, unit, month(month) ORDER BY year(month) RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS a FROM lo),
sm AS (SELECT variable, unit, kind, (month(month) % 12) // 3 AS k, (year(month) + (month(month) = 12)::INT)::BIGINT AS year, avg(a) AS value FROM an GROUP BY ALL HAVING count(a) = 3),
un AS (SELECT variable, count(DISTINCT unit) AS u FROM lo GROUP BY variable), wh AS (SELECT variable, k, year FROM sm JOIN un USING (variable) GROUP BY variable, k, year, u HAVING count(DISTINCT unit) = u),
se AS (SELECT variable, ['DJF', 'MAM', 'JJA', 'SON'][k + 1] AS season, year, unit, kind, x, value FROM sm JOIN wh USING (variable, k, year) JOIN ix USING (year) WHERE ix.mo = 3 * k + 1)"""
RANKED = SEASONS + """, rk AS (SELECT *, rank() OVER (PARTITION BY variable, season, unit ORDER BY x) + (count(*) OVER (PARTITION BY variable, season, unit, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY variable, season, unit ORDER BY value) + (count(*) OVER (PARTITION BY variable, season, unit, value) - 1) / 2.0::DOUBLE AS ry FROM se),
co AS (SELECT variable, season, unit, kind, count(*) AS n, CASE WHEN min(rx) = max(rx) OR min(ry) = max(ry) THEN 0.0 ELSE round(corr(rx, ry), 8) END AS r, round(regr_slope(value, x), 4) AS slope, count(*) FILTER (WHERE x >= 0.5) AS el_nino_n, round(avg(value) FILTER (WHERE x >= 0.5), 6) AS el_nino_mean, count(*) FILTER (WHERE x <= -0.5) AS la_nina_n, round(avg(value) FILTER (WHERE x <= -0.5), 6) AS la_nina_mean FROM rk GROUP BY ALL)"""


def index(t):
    """year, month, x: all orders in standard units."""
    rows = total(t)
    told = rows.agg(F.avg("n").alias("a"), F.stddev_pop("n").alias("s"))  # one row
    return rows.crossJoin(F.broadcast(told)).select(F.year("month").alias("year"), F.month("month").alias("month"), F.round((F.col("n") - F.col("a")) / F.col("s"), 6).alias("x"))


def long(t):
    rows = units(t).select("unit", F.year("month").alias("year"), F.month("month").alias("month"), F.round(F.col("v") / 1000).alias("value"), F.col("n").cast("double").alias("orders"))
    return R.melted(rows, ["unit", "year", "month"], ["value", "orders"])


def data(t):
    return K.season_data(long(t), index(t), HALF)


@query(SEASONS + " SELECT variable, season, year, unit, x, round(value, 6) AS value FROM se")
def season_data(t):
    """Season means of anomalies, whole over all units, with the index in the season's middle month."""
    return data(t).select("variable", "season", F.col("year").cast("long").alias("year"), "unit", "x", F.round("value", 6).alias("value"))


@query(RANKED + """, tt AS (SELECT *, round(1 - r * r, 8) AS p, kind = 'state' AS in_field FROM co), pl AS (SELECT *, row_number() OVER (PARTITION BY in_field ORDER BY p, variable, season, unit) AS place, count(*) OVER (PARTITION BY in_field) AS m FROM tt)
SELECT variable, season, unit, n, round(r, 6) + 0.0 AS r, slope, el_nino_n, el_nino_mean, la_nina_n, la_nina_mean, round(least(1.0, min(p * m / place) OVER (PARTITION BY in_field ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM pl""")
def fingerprint_field(t):
    """Correlations and composites by phase, q in two families (1 - r^2 stands in for p)."""
    found = K.composites(data(t), THRESHOLD, STRONG).withColumn("r", F.round("r", 8) + F.lit(0.0))
    state = units(t).select("unit", (F.col("kind") == "state").alias("in_field")).distinct()
    tested = S.with_q(found.join(state, "unit").withColumn("p", F.round(1 - F.col("r") * F.col("r"), 8)), "p", ["in_field"])
    return tested.select("variable", "season", "unit", "n", (F.round("r", 6) + F.lit(0.0)).alias("r"), F.round("slope", 4).alias("slope"), *[c for p in ("el_nino", "la_nina") for c in (f"{p}_n", F.round(f"{p}_mean", 6).alias(f"{p}_mean"))], F.round("q", 6).alias("q"))


@query(RANKED + " SELECT unit, variable || '_' || season AS feature, round(r, 6) + 0.0 AS r FROM co")
def cluster_features(t):
    """Each unit's rank correlations by variable and season."""
    return K.features(data(t)).select("unit", "feature", (F.round("r", 6) + F.lit(0.0)).alias("r"))


@query()
def fingerprint(t):
    """The fingerprint with p from surrogates and limits of the phase means from one pass of bootstrap weights."""
    states = F.col("unit").startswith("NATION_")
    return K.fingerprint(data(t), states, THRESHOLD, STRONG, 99, 200, seed=3)


@query(f"""WITH {MONTHLY}, k AS (SELECT nation, month, v FROM monthly WHERE n % 5 <> 0), s AS (SELECT nation, min(month) AS a, max(month) AS b FROM k GROUP BY nation),
p AS (SELECT nation, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM s), j AS (SELECT p.nation, p.month, v FROM p LEFT JOIN k ON p.nation = k.nation AND p.month = k.month)
SELECT nation, year(month)::BIGINT AS year, month(month)::BIGINT AS mo, v IS NOT NULL AS known, round(0.25 * lag(v) OVER (PARTITION BY nation ORDER BY month) + 0.75 * v, 4) AS blend FROM j""")
def panel_blend(t):
    """A gap-free panel of the months with a number of orders that 5 does not divide; a blend over a gap is unknown."""
    kept = monthly(t).where(F.col("n") % 5 != 0).select("nation", F.year("month").alias("year"), F.month("month").alias("month"), "v")
    rows = R.panel(kept, ["nation"], ["v"])
    before = F.lag("v").over(Window.partitionBy("nation").orderBy("at"))
    return rows.select("nation", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("mo"), "known", F.round(0.25 * before + 0.75 * F.col("v"), 4).alias("blend"))


@query()
def outlook_draws(t):
    """Weighted draws from each unit's season means, weighed by the index's nearness to 1; draws follow from unit and number alone."""
    rows = data(t).where("season = 'DJF' and variable = 'orders'").withColumn("w", F.exp(-0.5 * F.pow(F.col("x") - 1.0, 2))).withColumn("key", F.xxhash64("unit"))

    def drawn(g, rng):
        own = D.draws(g["value"].to_numpy(), g["w"].to_numpy(), 0.5, int(g["key"].iloc[0]), 20_000, 9)
        lo, mid, hi = map(float, np.quantile(own, [0.1, 0.5, 0.9]))
        return {"lo": lo, "median": mid, "hi": hi, "prob_negative": float((own < 0).mean())}

    return S.grouped(rows.select("unit", "year", "value", "w", "key"), ["unit"], "unit string, lo double, median double, hi double, prob_negative double", drawn, order=["year"])
