"""Queries on monthly series: hierarchy, normals, anomalies, runs, seasons, lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from thermocline.functions import columns as C
from thermocline.operators import relational as R
from thermocline.plans.registry import MEMBER, MONTHLY, TOTAL, UNITS, monthly, member, nations, query, total, units


@query(f"""WITH {UNITS}, p AS (SELECT unit, kind, month, v, avg(v) OVER (PARTITION BY unit, month(month) ORDER BY year(month) RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS normal FROM units)
SELECT unit, kind, month, v, round(normal, 4) AS normal, round(v - normal, 4) AS anomaly, round(100 * (v - normal) / normal, 6) AS anomaly_pct FROM p""")
def unit_anomaly(t):
    """Order value by unit and month against its leave-one-out normal."""
    rows = units(t).withColumn("__y", F.year("month")).withColumn("__m", F.month("month"))
    rows = rows.withColumn("__n", R.leave_one_out_normal("v", ["unit", "__m"], "__y", 3))
    gap = F.col("v") - F.col("__n")
    return rows.select("unit", "kind", "month", "v", F.round("__n", 4).alias("normal"), F.round(gap, 4).alias("anomaly"), F.round(100 * gap / F.col("__n"), 6).alias("anomaly_pct"))


@query(f"""WITH {UNITS}, k AS (SELECT *, CASE WHEN year(month) <= 1998 THEN v END AS seen FROM units)
SELECT unit, month, round(avg(seen) OVER (PARTITION BY unit, month(month) ORDER BY year(month) RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING EXCLUDE CURRENT ROW), 4) AS normal FROM k""")
def loo_normal_known(t):
    """W2 with an issue-time cut-off: only years up to 1998 contribute."""
    rows = units(t).withColumn("__y", F.year("month")).withColumn("__m", F.month("month"))
    return rows.select("unit", "month", F.round(R.leave_one_out_normal("v", ["unit", "__m"], "__y", 4, known=1998), 4).alias("normal"))


@query("SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month_no, CAST(day(last_day(o_orderdate)) AS BIGINT) AS days FROM orders")
def month_dims(t):
    """S16"""
    m = t.orders.select(C.month_start(F.col("o_orderdate")).alias("month")).distinct()
    return m.select("month", F.year("month").cast("long").alias("year"), F.month("month").cast("long").alias("month_no"), C.days_in_month(F.col("month")).alias("days"))


@query(f"WITH {MEMBER} SELECT unit, kind, nation AS member FROM member")
def unit_member(t):
    """The hierarchy: each nation in three units."""
    return member(t)


@query(f"WITH {MONTHLY}, {MEMBER} SELECT kind, count(*) AS n, count(DISTINCT unit) AS units, count(DISTINCT month) AS months FROM monthly JOIN member USING (nation) GROUP BY kind")
def unit_fanout(t):
    """J2 A14"""
    return R.fan_out(monthly(t), member(t), "nation").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("unit").alias("units"), F.countDistinct("month").alias("months"))


@query(f"""WITH {MONTHLY}, {MEMBER}, s AS (SELECT nation, sum(n)::DOUBLE AS weight FROM monthly GROUP BY nation)
SELECT unit, kind, month, round(sum(coalesce(v / n * w, 0)) / sum(w), 7) AS mean FROM (SELECT unit, kind, month, v, n, CASE WHEN kind = 'state' THEN 1.0 ELSE weight END AS w FROM monthly JOIN member USING (nation) JOIN s USING (nation)) GROUP BY ALL""")
def unit_mean(t):
    """A2: weighted mean over the hierarchy; leaves weigh 1 in their own rows."""
    base = monthly(t)
    weight = base.groupBy("nation").agg(F.sum("n").cast("double").alias("weight"))
    rows = R.fan_out(base, member(t), "nation").join(F.broadcast(weight), "nation").withColumn("w", F.when(F.col("kind") == "state", 1.0).otherwise(F.col("weight")))
    return rows.groupBy("unit", "kind", "month").agg(F.round(R.weighted_mean(F.col("v") / F.col("n"), F.col("w")), 7).alias("mean"))


@query("""WITH p AS (SELECT r_name AS region, n_name AS nation, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, c_mktsegment AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT region, nation, coalesce(sum(cents) FILTER (WHERE s = 'BUILDING'), 0)::BIGINT AS amount FROM p GROUP BY ALL)
SELECT region, nation, amount, round(amount / sum(amount) OVER (PARTITION BY region), 9) AS share FROM q""")
def share_weights(t):
    """A1: each nation's share of its region, missing as 0."""
    rows = t.customer.join(F.broadcast(nations(t)), F.col("c_nationkey") == F.col("n_nationkey"))
    part = rows.select("region", "nation", F.when(F.col("c_mktsegment") == "BUILDING", F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))
    return R.shares(part, "nation", "cents", ["region"]).select("region", "nation", "amount", F.round("share", 9).alias("share"))


@query(f"""WITH {TOTAL}, p AS (SELECT p_brand AS brand, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c, count(*) AS days FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(*) >= 8)
SELECT brand, p.month, round(c / 100.0 / days, 6) AS price, days, v AS order_value, round(c / 100.0 / days / v, 12) AS rate FROM p LEFT JOIN total ON p.month = total.month""")
def month_price_having(t):
    """Monthly mean price with a least number of trades, left-joined to the total, their ratio."""
    rows = t.lineitem.select("l_partkey", "l_shipdate", "l_extendedprice").join(t.part.select("p_partkey", F.col("p_brand").alias("brand")), F.col("l_partkey") == F.col("p_partkey"))
    price = rows.groupBy("brand", F.trunc("l_shipdate", "month").alias("month")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("c"), F.count("*").alias("days")).where("days >= 8")
    mean = F.col("c") / F.lit(100.0) / F.col("days")
    return price.join(F.broadcast(total(t).select("month", "v")), "month", "left").select("brand", "month", F.round(mean, 6).alias("price"), "days", F.col("v").alias("order_value"), F.round(F.try_divide(mean, F.col("v")), 12).alias("rate"))


SHIPPED = """shipped AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY ALL)"""


def shipped(t):
    return t.lineitem.groupBy(F.trunc("l_shipdate", "month").alias("month")).agg(F.sum("l_quantity").alias("q"))


@query(f"WITH {TOTAL}, {SHIPPED} SELECT coalesce(total.month, shipped.month) AS month, v, q FROM total FULL JOIN shipped ON total.month = shipped.month")
def full_outer_months(t):
    """J1"""
    return total(t).select("month", "v").join(shipped(t), "month", "full")


REGR = f"""WITH {TOTAL}, {SHIPPED}, b AS (SELECT month, v / 1e6 AS y, q / 1e3 AS x FROM total JOIN shipped USING (month) WHERE month < DATE '2001-06-01'), f AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(y, x) AS r, count(*) AS n, min(month) AS first, max(month) AS last FROM b)"""


def calibrated(t):
    both = total(t).select("month", (F.col("v") / 1e6).alias("y")).join(shipped(t).select("month", (F.col("q") / 1e3).alias("x")), "month").where(F.col("month") < F.lit("2001-06-01").cast("date"))
    fit = both.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("y", "x").alias("r"), F.count("*").alias("n"), F.min("month").alias("first"), F.max("month").alias("last"))
    return both, fit


@query(REGR + " SELECT round(intercept, 6) AS intercept, round(slope, 6) AS slope, round(r, 6) AS r, n, first, last, (SELECT round(sqrt(avg((y - intercept - slope * x) ** 2)), 6) FROM b) AS rmse FROM f")
def calibration(t):
    """M2: regression over the overlap, with its error."""
    both, fit = calibrated(t)
    error = both.crossJoin(F.broadcast(fit)).agg(F.round(F.sqrt(F.avg(F.pow(F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"), 2))), 6).alias("rmse"))
    return fit.select(F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope"), F.round("r", 6).alias("r"), "n", "first", "last").crossJoin(error)


@query(REGR + """ SELECT coalesce(t.month, s.month) AS month, round(coalesce(t.v / 1e6, intercept + slope * s.q / 1e3), 6) AS index, CASE WHEN t.v IS NULL THEN 'calibrated' ELSE 'direct' END AS source
FROM (SELECT * FROM total WHERE month < DATE '2001-06-01') t FULL JOIN shipped s ON t.month = s.month, f""")
def coalesce_splice(t):
    """One index where there is one, the calibrated other elsewhere, with its origin."""
    _, fit = calibrated(t)
    direct = total(t).where(F.col("month") < F.lit("2001-06-01").cast("date")).select("month", "v")
    rows = direct.join(shipped(t), "month", "full").crossJoin(F.broadcast(fit.select("slope", "intercept")))
    return rows.select("month", F.round(F.coalesce(F.col("v") / 1e6, F.col("intercept") + F.col("slope") * F.col("q") / 1e3), 6).alias("index"), F.when(F.col("v").isNull(), "calibrated").otherwise("direct").alias("source"))


@query(f"""WITH {UNITS}, s AS (SELECT unit, m::DATE AS month FROM (SELECT DISTINCT unit FROM units), (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS m FROM units)),
g AS (SELECT s.unit, s.month, v FROM s LEFT JOIN units u ON s.unit = u.unit AND s.month = u.month)
SELECT unit, month, CASE WHEN count(v) OVER w = 3 THEN round(avg(v) OVER w, 4) END AS running3, round(0.25 * lag(v) OVER (PARTITION BY unit ORDER BY month) + 0.75 * v, 4) AS blended FROM g WINDOW w AS (PARTITION BY unit ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def running3_lag_blend(t):
    """W1 W5 on a gap-free month spine."""
    rows = units(t)
    grid = R.month_spine(rows, "month", rows.select("unit").distinct()).join(rows.select("unit", "month", "v"), ["unit", "month"], "left")
    return grid.select("unit", "month", F.round(R.centred_mean("v", ["unit"], "month"), 4).alias("running3"), F.round(R.lag_blend("v", ["unit"], "month", 0.25), 4).alias("blended"))


@query(f"""WITH {UNITS}, y AS (SELECT *, CAST(year(month) AS BIGINT) AS yr, CAST(month(month) AS BIGINT) AS mo FROM units),
p AS (SELECT DISTINCT yr, greatest(least(floor((yr - 1996) / 2.0) * 2 + 1996 - 1 + 2, 2000) - 2, 1995)::BIGINT AS s FROM y),
c AS (SELECT p.yr, p.s, y.unit, y.mo, avg(y.v) AS clim FROM p JOIN y ON y.yr BETWEEN p.s AND p.s + 2 GROUP BY ALL)
SELECT y.unit, y.month, c.s AS base_start, c.s + 2 AS base_end, round(y.v - clim, 4) AS anomaly FROM y JOIN c ON y.yr = c.yr AND y.unit = c.unit AND y.mo = c.mo""")
def base_anomaly(t):
    """Anomaly from the climatology of the year's sliding base period (3 years, step 2)."""
    rows = units(t).withColumn("yr", F.year("month").cast("long")).withColumn("mo", F.month("month"))
    period = C.base_period(F.col("yr"), 1995, 2000, window=3, step=2, anchor=1996)
    periods = rows.select("yr").distinct().select("yr", period.alias("p")).select("yr", F.col("p.start").alias("base_start"), F.col("p.end").alias("base_end"))
    ref = rows.select(F.col("unit"), "mo", F.col("yr").alias("__y"), "v")
    clim = ref.join(F.broadcast(periods), F.col("__y").between(F.col("base_start"), F.col("base_end"))).groupBy("yr", "base_start", "base_end", "unit", "mo").agg(F.avg("v").alias("clim"))
    return rows.join(clim, ["yr", "unit", "mo"]).select("unit", "month", "base_start", "base_end", F.round(F.col("v") - F.col("clim"), 4).alias("anomaly"))


ANOMALY = f"""WITH {MONTHLY}, a AS (SELECT nation, month, round(v / avg(v) OVER (PARTITION BY nation) - 1, 6) AS x FROM monthly)"""


def anomaly(t):
    return monthly(t).withColumn("x", F.round(F.col("v") / F.avg("v").over(Window.partitionBy("nation")) - 1, 6)).select("nation", "month", "x")


RUNS = ANOMALY + """, k AS (SELECT *, CASE WHEN x >= 0.1 THEN 'warm' WHEN x <= -0.1 THEN 'cold' END AS phase, row_number() OVER (PARTITION BY nation ORDER BY month) AS rn, max(month) OVER (PARTITION BY nation) AS e FROM a),
i AS (SELECT *, rn - row_number() OVER (PARTITION BY nation, phase ORDER BY month) AS island FROM k),
r AS (SELECT nation, phase, min(month) AS first, max(month) AS last, count(*) AS months, round(sum(abs(x)), 6) AS intensity, arg_max(x, (abs(x), -epoch(month))) AS peak, arg_max(month, (abs(x), -epoch(month))) AS peak_at, any_value(e) AS e FROM i WHERE phase IS NOT NULL GROUP BY nation, phase, island),
runs AS (SELECT nation, phase, first, last, months, intensity, peak, peak_at, CASE WHEN last = e THEN 'ongoing' ELSE 'complete' END AS status FROM r WHERE months >= 2 OR last = e)"""


@query(RUNS + " SELECT *, CASE WHEN abs(peak) >= 0.6 THEN 'very_strong' WHEN abs(peak) >= 0.45 THEN 'strong' WHEN abs(peak) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM runs")
def islands_events(t):
    """Runs beyond a threshold, with their peak, intensity and strength."""
    found = R.runs(anomaly(t), ["nation"], "month", "x", 0.1, 2)
    return found.withColumn("intensity", F.round("intensity", 6)).withColumn("strength", C.strength(F.col("peak"), (0.15, 0.3, 0.45, 0.6)))


@query(RUNS + " SELECT a.nation, a.month, a.x, phase, first AS event_start FROM a LEFT JOIN runs ON a.nation = runs.nation AND a.month BETWEEN first AND last")
def interval_join(t):
    """The event that covers a month."""
    rows = anomaly(t)
    return R.covering(rows, "month", R.runs(rows, ["nation"], "month", "x", 0.1, 2).select("nation", "phase", "first", "last"), ["nation"]).select("nation", "month", "x", "phase", F.col("first").alias("event_start"))


@query(RUNS + """, w AS (SELECT DISTINCT nation, CAST(year(month) AS BIGINT) AS winter FROM a),
j AS (SELECT w.nation, w.winter, p.x AS predictor, d.x AS djf, coalesce(phase, 'neutral') AS phase, peak FROM w LEFT JOIN a p ON p.nation = w.nation AND p.month = make_date(w.winter, 8, 1) LEFT JOIN a d ON d.nation = w.nation AND d.month = make_date(w.winter + 1, 1, 1)
  LEFT JOIN runs e ON e.nation = w.nation AND make_date(w.winter + 1, 1, 1) BETWEEN e.first AND e.last)
SELECT nation, winter, winter || '-' || substr(CAST(winter + 1 AS VARCHAR), 3, 2) AS label, predictor, djf, phase, CASE WHEN phase = 'neutral' THEN 'neutral' ELSE CASE WHEN abs(peak) >= 0.6 THEN 'very_strong' WHEN abs(peak) >= 0.45 THEN 'strong' WHEN abs(peak) >= 0.3 THEN 'moderate' ELSE 'weak' END || '_' || phase END AS category FROM j""")
def winters(t):
    """A row for each winter: predictor in August, January's value, the event there and its category."""
    rows = anomaly(t)
    events = R.runs(rows, ["nation"], "month", "x", 0.1, 2).select("nation", "phase", "first", "last", "peak")
    each = rows.select("nation", F.year("month").cast("long").alias("winter")).distinct()
    year = F.col("winter").cast("int")
    each = each.withColumn("aug", F.make_date(year, F.lit(8), F.lit(1))).withColumn("jan", F.make_date(year + 1, F.lit(1), F.lit(1)))
    at = lambda on, name: rows.select("nation", F.col("month").alias(on), F.col("x").alias(name))
    joined = R.covering(each.join(at("aug", "predictor"), ["nation", "aug"], "left").join(at("jan", "djf"), ["nation", "jan"], "left"), "jan", events, ["nation"])
    phase = F.coalesce("phase", F.lit("neutral"))
    category = F.when(F.col("phase").isNull(), "neutral").otherwise(F.concat(C.strength(F.col("peak"), (0.15, 0.3, 0.45, 0.6)), F.lit("_"), F.col("phase")))
    return joined.select("nation", "winter", C.winter_label(F.col("winter")).alias("label"), "predictor", "djf", phase.alias("phase"), category.alias("category"))


@query(f"""WITH {MONTHLY}, s AS (SELECT nation, year(month) + (month(month) = 12)::INT AS season, v FROM monthly WHERE month(month) IN (12, 1, 2))
SELECT nation, CAST(season AS BIGINT) AS season, round(avg(v), 4) AS mean FROM s GROUP BY ALL HAVING count(v) = 3""")
def season_mean(t):
    """December to February by the year of January, complete seasons only."""
    rows = monthly(t).where(F.month("month").isin(12, 1, 2)).withColumn("season", C.djf_year(F.col("month")))
    return R.complete_mean(rows, ["nation", "season"], "v", 3).select("nation", "season", F.round("mean", 4).alias("mean"))


@query(f"""WITH {UNITS}, p AS (SELECT unit, month, v, avg(v) OVER (PARTITION BY unit, month(month) ORDER BY year(month) RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS nm FROM units),
w AS (SELECT unit, CAST(CASE WHEN month(month) >= 7 THEN year(month) ELSE year(month) - 1 END AS BIGINT) AS winter, v, nm FROM p WHERE month(month) IN (12, 1, 2))
SELECT unit, winter, round(100 * sum(v - nm) / sum(nm), 5) AS pct FROM w GROUP BY ALL HAVING count(v - nm) = 3""")
def winter_pct(t):
    """M7 M8: the winter's percent of normal, by the year of December."""
    rows = units(t).withColumn("__y", F.year("month")).withColumn("__m", F.month("month"))
    rows = rows.withColumn("nm", R.leave_one_out_normal("v", ["unit", "__m"], "__y", 3)).where(F.col("__m").isin(12, 1, 2)).withColumn("winter", C.winter_of(F.col("month")))
    return rows.groupBy("unit", "winter").agg(F.round(100 * F.sum(F.col("v") - F.col("nm")) / F.sum("nm"), 5).alias("pct"), F.count(F.col("v") - F.col("nm")).alias("__n")).where("__n = 3").drop("__n")


@query(f"WITH {MONTHLY} SELECT a.nation, a.month, a.v, b.v AS \"then\" FROM monthly a LEFT JOIN monthly b ON a.nation = b.nation AND b.month = CAST(a.month - INTERVAL 6 MONTH AS DATE)")
def date_shift_lookup(t):
    """The value six months before."""
    rows = monthly(t).select("nation", "month", "v")
    return R.shifted_lookup(rows, rows, "month", "v", 6, ["nation"])


@query(f"WITH {MONTHLY}, n AS (SELECT count(DISTINCT nation) AS k FROM monthly), c AS (SELECT month FROM monthly, n GROUP BY month, k HAVING count(v) = k) SELECT nation, month, v FROM monthly WHERE month IN (SELECT month FROM c)")
def finite_rows(t):
    """Months in which every nation has a value."""
    rows = monthly(t)
    whole = rows.groupBy("month").agg(F.count("v").alias("k"))
    expected = rows.select("nation").distinct().agg(F.count("*").alias("n"))
    keep = whole.crossJoin(F.broadcast(expected)).where("k = n").select("month")
    return rows.join(F.broadcast(keep), "month", "left_semi").select("nation", "month", "v")


@query(f"WITH {TOTAL}, c AS (SELECT month, v, avg(v) OVER (PARTITION BY month(month)) AS m FROM total) SELECT month, round(v - m, 4) AS centred FROM c")
def month_centre(t):
    """Value minus the mean of its calendar month."""
    return total(t).select("month", F.round(F.col("v") - F.avg("v").over(Window.partitionBy(F.month("month"))), 4).alias("centred"))


@query(f"""WITH {MONTHLY}, l AS (SELECT nation, max(month) AS month FROM monthly GROUP BY nation), s AS (SELECT m.nation, m.month, m.v, l.month AS latest FROM monthly m JOIN l ON m.nation = l.nation AND month(m.month) = month(l.month))
SELECT a.nation, a.month, a.v, 1 + count(b.v) AS rank FROM s a LEFT JOIN s b ON a.nation = b.nation AND b.v > a.v WHERE a.month = a.latest GROUP BY ALL""")
def latest_rank(t):
    """Rank of each nation's latest month among the same calendar months."""
    whole = Window.partitionBy("nation")
    rows = monthly(t).withColumn("latest", F.max("month").over(whole)).where(F.month("month") == F.month("latest"))
    rows = rows.withColumn("rank", F.rank().over(whole.orderBy(F.desc("v"))).cast("long"))
    return rows.where("month = latest").select("nation", "month", "v", "rank")


@query(f"WITH {MONTHLY} SELECT region, month(month)::BIGINT AS month_no, round(avg(v) FILTER (WHERE year(month) = 1996), 4) AS \"1996\", round(avg(v) FILTER (WHERE year(month) = 1997), 4) AS \"1997\", round(avg(v) FILTER (WHERE year(month) = 1998), 4) AS \"1998\" FROM monthly WHERE year(month) BETWEEN 1996 AND 1998 GROUP BY ALL")
def pivot_years(t):
    """Means by year as columns."""
    rows = monthly(t).where(F.year("month").between(1996, 1998)).withColumn("y", F.year("month"))
    return rows.groupBy("region", F.month("month").cast("long").alias("month_no")).pivot("y", [1996, 1997, 1998]).agg(F.round(F.avg("v"), 4))


@query(f"""WITH {MONTHLY}, f AS (SELECT nation, CAST(year(month) AS BIGINT) AS y, avg(v) AS fall FROM monthly WHERE month(month) IN (9, 10) GROUP BY ALL HAVING count(v) = 2),
w AS (SELECT nation, CAST(CASE WHEN month(month) >= 7 THEN year(month) ELSE year(month) - 1 END AS BIGINT) AS y, avg(v) AS winter FROM monthly WHERE month(month) IN (12, 1, 2) GROUP BY ALL HAVING count(v) = 3)
SELECT nation, y AS winter, round(100 * ln(winter / fall), 6) AS premium FROM f JOIN w USING (nation, y)""")
def premium(t):
    """Log premium of a complete winter over its complete fall."""
    return premiums(t).select("nation", "winter", F.round("premium", 6).alias("premium"))


def premiums(t):
    rows = monthly(t).withColumn("y", C.winter_of(F.col("month")))
    fall = R.complete_mean(rows.where(F.month("month").isin(9, 10)), ["nation", "y"], "v", 2).withColumnRenamed("mean", "fall")
    cold = R.complete_mean(rows.where(F.month("month").isin(12, 1, 2)), ["nation", "y"], "v", 3).withColumnRenamed("mean", "w")
    return fall.join(cold, ["nation", "y"]).select("nation", F.col("y").alias("winter"), (100 * F.ln(F.col("w") / F.col("fall"))).alias("premium"))


@query(f"""WITH {MONTHLY}, f AS (SELECT nation, CAST(year(month) AS BIGINT) AS y, avg(v) AS fall FROM monthly WHERE month(month) IN (9, 10) GROUP BY ALL HAVING count(v) = 2),
w AS (SELECT nation, CAST(CASE WHEN month(month) >= 7 THEN year(month) ELSE year(month) - 1 END AS BIGINT) AS y, avg(v) AS winter, avg(n) AS n FROM monthly WHERE month(month) IN (12, 1, 2) GROUP BY ALL HAVING count(v) = 3),
p AS (SELECT nation, y, n, 100 * ln(winter / fall) AS premium FROM f JOIN w USING (nation, y))
SELECT nation, count(*) AS winters, min(y) AS first, max(y) AS last, round(regr_slope(premium, n), 6) AS slope, round(regr_intercept(premium, n), 6) AS intercept, round(corr(premium, n), 6) AS r, round(sqrt(regr_syy(premium, n) * (1 - corr(premium, n) ** 2) / (count(*) - 2)), 5) AS resid_sd FROM p GROUP BY nation HAVING count(*) >= 4""")
def premium_reg(t):
    """Regression of the premium on the winter's orders, residual sd with two degrees less."""
    rows = monthly(t).withColumn("winter", C.winter_of(F.col("month"))).where(F.month("month").isin(12, 1, 2)).groupBy("nation", "winter").agg(F.avg("n").alias("n"))
    both = premiums(t).join(rows, ["nation", "winter"])
    sd = F.sqrt(F.regr_syy("premium", "n") * (1 - F.pow(F.corr("premium", "n"), 2)) / (F.count("*") - 2))
    return both.groupBy("nation").agg(F.count("*").alias("winters"), F.min("winter").alias("first"), F.max("winter").alias("last"), F.round(F.regr_slope("premium", "n"), 6).alias("slope"), F.round(F.regr_intercept("premium", "n"), 6).alias("intercept"), F.round(F.corr("premium", "n"), 6).alias("r"), F.round(F.when(F.count("*") > 2, sd), 5).alias("resid_sd")).where("winters >= 4")


@query("""WITH d AS (SELECT event_type AS kind, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT kind, day, n, CAST(day - lag(day) OVER (PARTITION BY kind ORDER BY day) AS BIGINT) AS gap FROM d""")
def day_gaps(t):
    """Days between neighbouring rows."""
    rows = t.events.groupBy(F.col("event_type").alias("kind"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return rows.withColumn("gap", F.date_diff("day", F.lag("day").over(Window.partitionBy("kind").orderBy("day"))).cast("long"))
