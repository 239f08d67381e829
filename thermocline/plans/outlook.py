"""Queries on price spreads, scenarios and the outlook."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from thermocline.functions import columns as C
from thermocline.operators import models as D
from thermocline.operators import relational as R
from thermocline.operators import stats as S
from thermocline.plans.mining import MEMBERS, permuted_correlation, permuted_sql, yearly
from thermocline.plans.registry import MONTHLY, TOTAL, monthly, query, total
from thermocline.plans.series import premiums

SPREAD = f"""WITH {MONTHLY}, sp AS (SELECT a.month, round(100 * ln(a.v / b.v), 8) AS spread FROM monthly a JOIN monthly b ON a.month = b.month WHERE a.nation = 'NATION_0' AND b.nation = 'NATION_1'),
ce AS (SELECT month, spread, spread - avg(spread) OVER (PARTITION BY month(month)) AS centred FROM sp)"""


def spread(t):
    """Log spread of two series, minus its calendar month's mean."""
    of = lambda n, name: monthly(t).where(F.col("nation") == n).select("month", F.col("v").alias(name))
    rows = of("NATION_0", "a").join(of("NATION_1", "b"), "month").select("month", F.round(100 * F.ln(F.col("a") / F.col("b")), 8).alias("spread"))
    return rows.withColumn("centred", F.col("spread") - F.avg("spread").over(Window.partitionBy(F.month("month"))))


@query(SPREAD + " SELECT month, round(spread, 6) AS spread, round(centred, 6) AS centred FROM ce")
def hub_spread(t):
    """A8"""
    return spread(t).select("month", F.round("spread", 6).alias("spread"), F.round("centred", 6).alias("centred"))


@query(SPREAD + " SELECT CAST(year(month) - 1 AS BIGINT) AS winter, round(avg(centred), 6) AS spring_spread FROM ce WHERE month(month) BETWEEN 3 AND 6 GROUP BY ALL HAVING count(centred) = 4")
def hydro_season(t):
    """The spring's mean spread by winter, complete springs only."""
    rows = spread(t).where(F.month("month").between(3, 6)).withColumn("winter", (F.year("month") - 1).cast("long"))
    return R.complete_mean(rows, ["winter"], "centred", 4).select("winter", F.round("mean", 6).alias("spring_spread"))


HYDRO = SPREAD + """, dr AS (SELECT CAST(CASE WHEN month(month) >= 7 THEN year(month) ELSE year(month) - 1 END AS BIGINT) AS winter, sum(n)::DOUBLE AS x FROM monthly WHERE month(month) IN (10, 11, 12, 1, 2, 3) GROUP BY ALL)"""


@query(HYDRO + " SELECT CAST(month(month) AS BIGINT) AS month_no, count(*) AS winters, round(corr(centred, x), 6) AS r, round(regr_slope(centred, x), 8) AS slope FROM ce JOIN dr ON year(month) - 1 = winter WHERE month(month) <= 9 GROUP BY ALL")
def hydro_lag(t):
    """Correlation of each month's spread with the half-year before it."""
    return hydro(t).groupBy("month_no").agg(F.count("*").alias("winters"), F.round(F.corr("centred", "x"), 6).alias("r"), F.round(F.regr_slope("centred", "x"), 8).alias("slope"))


def hydro(t):
    wet = monthly(t).where(F.month("month").isin(10, 11, 12, 1, 2, 3)).groupBy(C.winter_of(F.col("month")).alias("winter")).agg(F.sum("n").cast("double").alias("x"))
    rows = spread(t).where(F.month("month") <= 9).withColumn("winter", (F.year("month") - 1).cast("long"))
    return rows.join(F.broadcast(wet), "winter").select(F.month("month").cast("long").alias("month_no"), "winter", "centred", "x")


@query(HYDRO + ", hy AS (SELECT CAST(month(month) AS BIGINT) AS month_no, winter, centred, x FROM ce JOIN dr ON year(month) - 1 = winter WHERE month(month) <= 9), " + permuted_sql("hy", "month_no", "winter", "centred", "x") + """,
q AS (SELECT *, row_number() OVER (ORDER BY p, month_no) AS place, count(*) OVER () AS m FROM pt)
SELECT month_no, round(r, 6) AS r, round(p, 6) AS p, round(least(1.0, min(p * m / place) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM q""")
def hydro_lag_test(t):
    """Permutation p for each month, then BH over the months."""
    found = S.with_q(permuted_correlation(hydro(t), ["month_no"], "winter", "centred", "x"), "p")
    return found.select("month_no", *[F.round(c, 6).alias(c) for c in ("r", "p", "q")])


SCENARIOS = MEMBERS + """, sc AS (SELECT nation, yr, x, z, s FROM y, (SELECT unnest([8.0::DOUBLE, 10.0, 12.0]) AS s)), t AS (SELECT *, unnest(range(0, 40)) AS k FROM sc), w AS (SELECT *, exp(-0.5 * ((z - s) / (0.4 * 1.25 ** k)) ** 2) AS w FROM t),
e AS (SELECT nation, s, k, sum(w) AS total, CASE WHEN sum(w * w) > 0 THEN sum(w) ** 2 / sum(w * w) END AS ess, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT nation, s, min(k) AS k FROM e WHERE ess >= least(3.0, n) - 1e-12 GROUP BY ALL),
kw AS (SELECT sc.nation, sc.s, sc.x, coalesce(w.w / e.total, 1.0 / count(*) OVER (PARTITION BY sc.nation, sc.s)) AS w FROM sc LEFT JOIN f USING (nation, s) LEFT JOIN e ON e.nation = f.nation AND e.s = f.s AND e.k = f.k LEFT JOIN w ON w.nation = sc.nation AND w.s = sc.s AND w.yr = sc.yr AND w.k = f.k)"""


@query(SCENARIOS + " SELECT nation, s AS scenario, round(sum(w * x), 6) AS mean, round(coalesce(sum(w) FILTER (WHERE x > 10), 0), 8) AS prob_above FROM kw GROUP BY ALL")
def outlook_scenarios(t):
    """The weighted members of each scenario, all scenarios in one plan."""
    rows = yearly(t).withColumn("scenario", F.explode(F.array(F.lit(8.0), F.lit(10.0), F.lit(12.0))))
    w = S.kernel_weights(rows, ["nation", "scenario"], "z", F.col("scenario"), 0.4, 3.0)
    above = F.coalesce(F.sum(F.when(F.col("x") > 10, F.col("w"))), F.lit(0.0))
    return w.groupBy("nation", "scenario").agg(F.round(F.sum(F.col("w") * F.col("x")), 6).alias("mean"), F.round(above, 8).alias("prob_above"))


@query()
def outlook_price(t):
    """The yearly members through the premium regression, as a mixture in closed form instead of draws."""
    z = yearly(t).select("nation", F.col("yr").alias("winter"), "z")
    fit = premiums(t).join(z, ["nation", "winter"]).groupBy("nation").agg(F.regr_slope("premium", "z").alias("slope"), F.regr_intercept("premium", "z").alias("intercept"), F.sqrt(F.regr_syy("premium", "z") * (1 - F.pow(F.corr("premium", "z"), 2)) / F.greatest(F.count("*") - 2, F.lit(1))).alias("sd")).dropna()
    rows = z.join(fit, "nation")

    def one(g, rng):
        mu, sigma = D.propagated(g["z"].to_numpy(), g["intercept"].iloc[0], g["slope"].iloc[0], 0.5, g["sd"].iloc[0])
        got = D.summary(mu, np.ones(len(mu)), sigma)
        return {"median": got["median"], "lo": got["lo"], "hi": got["hi"], "prob_negative": 1 - got["prob_above"]}

    return S.grouped(rows, ["nation"], "nation string, median double, lo double, hi double, prob_negative double", one, order=["winter"])


@query(f"""WITH {TOTAL}, l AS (SELECT max(month) AS m FROM total), c AS (SELECT * FROM total, l WHERE month(month) = month(m))
SELECT 'latest_month' AS key, strftime(m, '%Y-%m') AS value FROM l UNION ALL SELECT 'latest_cents', CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR) FROM c WHERE month = m
UNION ALL SELECT 'rank', CAST(1 + count(*) FILTER (WHERE v > (SELECT v FROM c WHERE month = m)) AS VARCHAR) FROM c UNION ALL SELECT 'years', CAST(count(*) AS VARCHAR) FROM c""")
def outlook_status(t):
    """Keys and values about the latest month."""
    rows = total(t)
    latest = rows.agg(F.max("month").alias("m"), F.max_by("v", "month").alias("now"))
    same = rows.crossJoin(F.broadcast(latest)).where(F.month("month") == F.month("m"))
    one = same.groupBy("m", "now").agg((F.count_if(F.col("v") > F.col("now")) + 1).alias("rank"), F.count("*").alias("years"))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (("latest_month", F.date_format("m", "yyyy-MM")), ("latest_cents", F.round(F.col("now") * 100).cast("long")), ("rank", F.col("rank")), ("years", F.col("years")))])
    return one.select(F.explode(pairs).alias("p")).select("p.key", "p.value")
