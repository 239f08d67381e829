"""Queries on statistics, mining, forecasts and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from thermocline.functions import columns as C
from thermocline.operators import mining as N
from thermocline.operators import models as D
from thermocline.operators import neighbours as NB
from thermocline.operators import pairs as P
from thermocline.operators import relational as R
from thermocline.operators import stats as S
from thermocline.plans.registry import MONTHLY, TOTAL, monthly, query, total
from thermocline.session import written

RANKS = f"""WITH {MONTHLY}, {TOTAL}, b AS (SELECT nation, region, month(m.month)::BIGINT AS mo, m.v AS y, total.v AS x FROM monthly m JOIN total USING (month)),
k AS (SELECT nation, mo, rank() OVER (PARTITION BY nation, mo ORDER BY x) + (count(*) OVER (PARTITION BY nation, mo, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY nation, mo ORDER BY y) + (count(*) OVER (PARTITION BY nation, mo, y) - 1) / 2.0 AS ry FROM b),
field AS (SELECT nation, mo, count(*) AS n, CASE WHEN isfinite(corr(rx, ry)) THEN round(corr(rx, ry), 8) + 0.0 ELSE 0.0 END AS r FROM k GROUP BY ALL),
tested AS (SELECT *, round(1 - r * r, 8) + 0.0 AS p FROM field),
q AS (SELECT *, row_number() OVER (ORDER BY p, nation, mo) AS place, count(*) OVER () AS m FROM tested),
bh AS (SELECT *, least(1.0, min(p * m / place) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM q)"""


def field(t):
    """Rank correlation of each nation's months with the total, by calendar month; 1 - r^2 stands in for p."""
    both = monthly(t).select("nation", "month", F.col("v").alias("y")).join(F.broadcast(total(t).select("month", F.col("v").alias("x"))), "month").withColumn("mo", F.month("month").cast("long"))
    return S.spearman(both, ["nation", "mo"], "x", "y").withColumn("r", F.round("r", 8) + F.lit(0.0)).withColumn("p", F.round(1 - F.col("r") * F.col("r"), 8))


@query(RANKS + " SELECT nation, mo, n, round(r, 6) + 0.0 AS r FROM field")
def spearman(t):
    """W7 M16"""
    return field(t).select("nation", "mo", "n", (F.round("r", 6) + F.lit(0.0)).alias("r"))


@query(RANKS + " SELECT nation, mo, round(p, 6) AS p, round(q, 6) AS q, q <= 0.5 AS significant FROM bh")
def bh_q(t):
    """False discovery rates over the whole field."""
    found = S.with_q(field(t), "p")
    return found.select("nation", "mo", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), (F.col("q") <= 0.5).alias("significant"))


@query(RANKS + """, f AS (SELECT nation, mo, p, row_number() OVER (PARTITION BY mo ORDER BY p, nation) AS place, count(*) OVER (PARTITION BY mo) AS m FROM tested),
h AS (SELECT *, (SELECT sum(1.0::DOUBLE / i) FROM range(1, m + 1) x(i)) AS c FROM f)
SELECT nation, mo, round(least(1.0, min(p * m / place * c) OVER (PARTITION BY mo ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM h""")
def by_q(t):
    """The stricter rate, in a family for each month."""
    return S.with_q(field(t), "p", ["mo"], "by").select("nation", "mo", F.round("q", 6).alias("q"))


@query(RANKS + " SELECT mo, count(*) AS tests, count(*) FILTER (WHERE q <= 0.5) AS discoveries, round(0.5 * count(*) FILTER (WHERE q <= 0.5), 2) AS expected_false, count(*) FILTER (WHERE p <= 0.2) AS uncorrected FROM bh GROUP BY mo")
def fdr_summary(t):
    """A9 M12"""
    found = S.with_q(field(t), "p")
    hits = F.count_if(F.col("q") <= 0.5)
    return found.groupBy("mo").agg(F.count("*").alias("tests"), hits.alias("discoveries"), F.round(0.5 * hits, 2).alias("expected_false"), F.count_if(F.col("p") <= 0.2).alias("uncorrected"))


@query(f"WITH {MONTHLY}, {TOTAL} SELECT nation, month(month)::BIGINT AS mo, round(regr_slope(monthly.v, total.v), 8) AS slope FROM monthly JOIN total USING (month) GROUP BY ALL")
def slope_field(t):
    """M13"""
    both = monthly(t).select("nation", "month", F.col("v").alias("y")).join(F.broadcast(total(t).select("month", F.col("v").alias("x"))), "month")
    return both.groupBy("nation", F.month("month").cast("long").alias("mo")).agg(F.round(F.regr_slope("y", "x"), 8).alias("slope"))


@query("SELECT c_nationkey AS nation, round(corr(c_acctbal, length(c_name) + c_custkey % 7), 6) AS r, count(*) AS n FROM customer GROUP BY ALL")
def grouped_corr(t):
    """A12"""
    return t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.round(F.corr("c_acctbal", (F.length("c_name") + F.col("c_custkey") % 7).cast("double")), 6).alias("r"), F.count("*").alias("n"))


BASKETS = f"""WITH {MONTHLY}, v AS (SELECT region, month, sum(CAST(round(v * 100) AS BIGINT)) AS v FROM monthly GROUP BY ALL), t AS (SELECT region, quantile_cont(v, 1/3::DOUBLE) AS lo, quantile_cont(v, 2/3::DOUBLE) AS hi FROM v GROUP BY region),
i AS (SELECT month, CASE WHEN v > hi THEN 'high:' || region WHEN v < lo THEN 'low:' || region END AS item FROM v JOIN t USING (region) UNION ALL SELECT DISTINCT month, 'season=' || CASE WHEN month(month) IN (12, 1, 2) THEN 'winter' WHEN month(month) BETWEEN 6 AND 8 THEN 'summer' ELSE 'other' END FROM v),
i2 AS MATERIALIZED (SELECT * FROM i WHERE item IS NOT NULL), nb AS (SELECT count(DISTINCT month) AS nb FROM i2)"""
SETS = BASKETS + """, s1 AS MATERIALIZED (SELECT [item] AS items, count(*) AS n FROM i2 GROUP BY item HAVING count(*) >= 4),
s2 AS MATERIALIZED (SELECT [a.item, b.item] AS items, count(*) AS n FROM i2 a JOIN i2 b ON a.month = b.month AND a.item < b.item GROUP BY ALL HAVING count(*) >= 4),
s3 AS MATERIALIZED (SELECT [a.item, b.item, c.item] AS items, count(*) AS n FROM i2 a JOIN i2 b ON a.month = b.month AND a.item < b.item JOIN i2 c ON a.month = c.month AND b.item < c.item GROUP BY ALL HAVING count(*) >= 4),
s AS MATERIALIZED (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"""
RULES = SETS + """, c AS MATERIALIZED (SELECT list_filter(items, lambda x: x LIKE 'season=%')[1] AS antecedent, list_filter(items, lambda x: x NOT LIKE 'season=%') AS consequent, n FROM s WHERE len(items) >= 2 AND len(list_filter(items, lambda x: x LIKE 'season=%')) = 1),
ru AS MATERIALIZED (SELECT antecedent, consequent, c.n, a.n AS antecedent_n, c.n / a.n AS confidence, b.n / nb AS base_rate, c.n / a.n / (b.n / nb) AS lift FROM c JOIN s a ON a.items = [antecedent] JOIN s b ON b.items = consequent, nb WHERE c.n / a.n >= 0.2 AND c.n / a.n / (b.n / nb) >= 1.1)"""


def baskets(t):
    """A basket for each month: regions above or below their terciles, and the season."""
    rows = monthly(t).groupBy("region", "month").agg(F.sum(F.round(F.col("v") * 100).cast("long")).alias("v"))
    cuts = rows.groupBy("region").agg(F.percentile("v", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c"))
    marked = rows.join(F.broadcast(cuts), "region")
    item = F.when(F.col("v") > F.col("c")[1], F.concat(F.lit("high:"), "region")).when(F.col("v") < F.col("c")[0], F.concat(F.lit("low:"), "region"))
    m = F.month("month")
    season = F.concat(F.lit("season="), F.when(m.isin(12, 1, 2), "winter").when(m.between(6, 8), "summer").otherwise("other"))
    return marked.groupBy("month").agg(F.collect_set(item).alias("own")).select("month", F.array_sort(F.array_union("own", F.array(season))).alias("items"))


@query(BASKETS + " SELECT month, string_agg(item, ' ' ORDER BY item) AS items FROM i2 GROUP BY month")
def tercile_baskets(t):
    """W11 M30 A11"""
    return baskets(t).select("month", F.array_join("items", " ").alias("items"))


@query(SETS + " SELECT array_to_string(items, ' ') AS items, len(items)::BIGINT AS size, n FROM s")
def itemsets(t):
    """M28 M29"""
    return N.itemsets(baskets(t), "items", 4, 3).select(F.array_join("items", " ").alias("items"), F.size("items").cast("long").alias("size"), "n")


def found_rules(t):
    rows = written(baskets(t), "baskets")
    return N.rules(N.itemsets(rows, "items", 4, 3), rows.count(), "season=", 0.2, 1.1)


@query(RULES + " SELECT antecedent, array_to_string(consequent, ' ') AS consequent, n, antecedent_n, round(confidence, 8) AS confidence, round(base_rate, 8) AS base_rate, round(lift, 8) AS lift FROM ru")
def association_rules(t):
    """M31"""
    return found_rules(t).select("antecedent", F.array_join("consequent", " ").alias("consequent"), "n", "antecedent_n", *[F.round(c, 8).alias(c) for c in ("confidence", "base_rate", "lift")])


@query(RULES + """, b AS (SELECT month, list(item ORDER BY item) AS items FROM i2 GROUP BY month),
h AS (SELECT DISTINCT antecedent, hits FROM (SELECT antecedent, consequent, list(month ORDER BY month) AS hits FROM ru JOIN b ON list_contains(items, antecedent) AND list_has_all(items, consequent) GROUP BY ALL)),
x AS (SELECT antecedent, hits, item FROM (SELECT antecedent, hits, unnest(hits) AS month FROM h) JOIN i2 USING (month) GROUP BY ALL HAVING count(*) = len(hits))
SELECT antecedent, string_agg(item, ' ' ORDER BY item) AS consequent, len(hits)::BIGINT AS n, strftime(hits[1], '%Y-%m-%d') AS first_hit FROM x WHERE item NOT LIKE 'season=%' GROUP BY antecedent, hits""")
def closed_rules(t):
    """M32"""
    found = N.closed_rules(found_rules(t), baskets(t), "month", "items", "season=")
    return found.select("antecedent", F.array_join("consequent", " ").alias("consequent"), "n", F.date_format(F.col("hits")[0], "yyyy-MM-dd").alias("first_hit"))


SHUFFLES = 199
#: A shuffle's order of things: by a digest of its number and their key, so that SQL and Spark draw alike.
DRAW_SQL = "md5(rep || ':' || {key})"


def drawn(key):
    return F.md5(F.concat_ws(":", F.col("rep").cast("string"), key))


def shuffled(rows, first: int = 1, last: int = SHUFFLES):
    """rows for each shuffle (rep)."""
    return rows.withColumn("rep", F.explode(F.sequence(F.lit(first), F.lit(last))))


@query(RULES + f""", b AS (SELECT DISTINCT month FROM i2), o AS (SELECT rep, month, row_number() OVER (PARTITION BY rep ORDER BY {DRAW_SQL.format(key="strftime(month, '%Y-%m-%d')")}, month) AS place FROM b, range(1, {SHUFFLES + 1}) x(rep)),
bi AS (SELECT month, list(item) AS items FROM i2 GROUP BY month), m AS (SELECT antecedent, consequent, antecedent_n, month FROM ru JOIN bi ON list_has_all(items, consequent)),
h AS (SELECT antecedent, consequent, rep, count(*) FILTER (WHERE place <= antecedent_n) AS hits FROM m JOIN o USING (month) GROUP BY ALL),
e AS (SELECT ru.antecedent, array_to_string(ru.consequent, ' ') AS consequent, ru.n, (1 + count(*) FILTER (WHERE hits >= ru.n)) / {SHUFFLES + 1}.0::DOUBLE AS p FROM ru LEFT JOIN h USING (antecedent, consequent) GROUP BY ALL),
q AS (SELECT *, row_number() OVER (ORDER BY p, antecedent, consequent) AS place, count(*) OVER () AS m FROM e)
SELECT antecedent, consequent, n, round(p, 6) AS p, round(least(1.0, min(p * m / place) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM q""")
def rule_test(t):
    """One-sided permutation p of each rule's hits, then BH."""
    beyond = shuffle_p(found_rules(t), baskets(t), "month", F.date_format("month", "yyyy-MM-dd"), SHUFFLES)
    named = beyond.select("antecedent", F.array_join("consequent", " ").alias("consequent"), "n", "p")
    return S.with_q(named, "p").select("antecedent", "consequent", "n", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


def shuffle_p(found, rows, key: str, text, shuffles: int):
    """antecedent, consequent (array), n, p of rules (with antecedent_n) over baskets (key, items); text is the key as text.

    A shuffle puts the baskets in an order of its own and deals the antecedent to the first of them,
    as many as have it; a rule's hits are then the baskets with its consequent among those. The order
    of a shuffle is a window of its own: one shuffle's baskets are sorted together.
    """
    order = shuffled(rows.select(key), last=shuffles).withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(drawn(text), key)))
    item = rows.select(key, F.explode("items").alias("i"))
    want = found.select("antecedent", "consequent", "antecedent_n", F.explode("consequent").alias("i"))
    met = want.join(item, "i").groupBy("antecedent", "consequent", "antecedent_n", key).count().where(F.col("count") == F.size("consequent"))
    hits = met.join(order, key).where("place <= antecedent_n").groupBy("antecedent", "consequent", "rep").agg(F.count("*").alias("hits"))
    beyond = found.join(hits, ["antecedent", "consequent"], "left").groupBy("antecedent", "consequent", "n")
    return beyond.agg(((1 + F.count_if(F.col("hits") >= F.col("n"))) / F.lit(shuffles + 1.0)).alias("p"))


VEC = """WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), q AS (SELECT vec_id AS q, a AS qa FROM e WHERE vec_id % 100 = 0),
p AS (SELECT q, vec_id, qa, a FROM q JOIN e ON vec_id <> q)"""
APART = "sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (qa[i] - a[i]) * (qa[i] - a[i]))))"


def vectors(t):
    return t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("a"))


def asked(t):
    """The stated query set: ids divisible by 100."""
    return vectors(t).where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("a").alias("qa"))


def measured(t, band=None):
    """q, key, d: every query against all other rows, in tiles."""
    return P.distances(t.embeddings.select(F.col("vec_id").alias("key"), F.col("embedding").alias("a")), asked(t), band)


@query(VEC + f" SELECT q, vec_id, round(d0, 6) AS d, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d0, vec_id) AS rank FROM (SELECT q, vec_id, round({APART}, 9) AS d0 FROM p)) WHERE rank <= 8")
def knn_topk(t):
    """The nearest eight of each query vector; blocks and rows out of reach are never measured."""
    best, _ = NB.search(NB.build(vectors(t), "vec_id", "a"), asked(t), "q", "qa", 8)
    return best.select("q", F.col("key").alias("vec_id"), F.round("d", 6).alias("d"), "rank")


@query(VEC + """ SELECT q, vec_id, round(sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: greatest(a[i] - list_max(qa[greatest(i - 2, 1):least(i + 2, len(a))]), list_min(qa[greatest(i - 2, 1):least(i + 2, len(a))]) - a[i], 0.0) ** 2))), 6) AS bound FROM p""")
def lb_keogh(t):
    """The envelope bound of each pair of the query set."""
    return measured(t, band=2).select("q", F.col("key").alias("vec_id"), F.col("d").alias("bound"))


@query(VEC + f" SELECT q AS a, vec_id AS b, round({APART}, 6) AS d FROM p WHERE q < vec_id OR vec_id % 100 <> 0")
def pair_distances(t):
    """Distances between the query vectors and all vectors, each pair once."""
    pairs = measured(t).where((F.col("q") < F.col("key")) | (F.col("key") % 100 != 0))
    return pairs.select(F.col("q").alias("a"), F.col("key").alias("b"), "d")


@query(VEC + """, w AS (SELECT q, vec_id, qa, a, 0 AS d, list_transform(range(0, len(a) + 1), lambda i: CASE WHEN i = 1 THEN (qa[1] - a[1]) ** 2 ELSE 'inf'::DOUBLE END) AS p1, list_transform(range(0, len(a) + 1), lambda i: 'inf'::DOUBLE) AS p2 FROM p
UNION ALL SELECT q, vec_id, qa, a, d + 1, list_transform(range(0, len(a) + 1), lambda i: CASE WHEN i >= 1 AND d + 2 - i BETWEEN 0 AND len(a) - 1 AND abs(2 * (i - 1) - (d + 1)) <= 2 THEN (qa[i] - a[d + 3 - i]) ** 2 + least(p1[i], p1[i + 1], p2[i]) ELSE 'inf'::DOUBLE END), p1 FROM w WHERE d < 2 * len(a) - 2),
z AS (SELECT q, vec_id, round(sqrt(p1[len(a) + 1]), 9) AS d0 FROM w WHERE d = 2 * len(a) - 2)
SELECT q, vec_id, round(d0, 6) AS dtw, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d0, vec_id) AS rank FROM z) WHERE rank <= 8""")
def dtw_nearest(t):
    """The eight nearest by time warping; blocks and rows beyond the eighth's bound are never warped."""
    best, _ = NB.search(NB.build(vectors(t), "vec_id", "a"), asked(t), "q", "qa", 8, band=2)
    return best.select("q", F.col("key").alias("vec_id"), F.round("d", 6).alias("dtw"), "rank")


MEMBERS = f"""WITH {MONTHLY}, y AS (SELECT nation, CAST(year(month) AS BIGINT) AS yr, round(sum(CAST(round(v * 100) AS BIGINT)) / 100.0::DOUBLE / count(*) / 1e5, 6) AS x, round(avg(n), 6) AS z FROM monthly GROUP BY ALL)"""


def yearly(t):
    return monthly(t).groupBy("nation", F.year("month").cast("long").alias("yr")).agg(F.round(F.sum(F.round(F.col("v") * 100).cast("long")) / F.lit(100.0) / F.count("*") / 1e5, 6).alias("x"), F.round(F.avg("n"), 6).alias("z"))


WEIGHTS = MEMBERS + """, t AS (SELECT nation, yr, z, unnest(range(0, 40)) AS k FROM y), w AS (SELECT nation, yr, k, 0.2 * 1.25 ** k AS h, exp(-0.5 * ((z - 10) / (0.2 * 1.25 ** k)) ** 2) AS w FROM t),
e AS (SELECT nation, k, any_value(h) AS h, sum(w) AS total, CASE WHEN sum(w * w) > 0 THEN sum(w) ** 2 / sum(w * w) END AS ess, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT nation, min(k) AS k FROM e WHERE ess >= least(4.0, n) - 1e-12 GROUP BY nation),
kw AS (SELECT y.nation, y.yr, y.x, coalesce(w.w / e.total, 1.0 / count(*) OVER (PARTITION BY y.nation)) AS w, e.h, coalesce(e.ess, count(*) OVER (PARTITION BY y.nation)) AS ess FROM y LEFT JOIN f USING (nation) LEFT JOIN e ON e.nation = f.nation AND e.k = f.k LEFT JOIN w ON w.nation = y.nation AND w.yr = y.yr AND w.k = f.k)"""


def weights(t):
    return S.kernel_weights(yearly(t), ["nation"], "z", F.lit(10.0), 0.2, 4.0)


@query(WEIGHTS + " SELECT nation, yr, round(w, 8) AS w, round(h, 8) AS h, round(ess, 6) AS ess FROM kw")
def kernel_weights(t):
    """Gaussian weights around 10 orders, widened to an effective size of four."""
    return weights(t).select("nation", "yr", F.round("w", 8).alias("w"), F.round("h", 8).alias("h"), F.round("ess", 6).alias("ess"))


@query(WEIGHTS + """, c AS (SELECT nation, x, sum(w) OVER (PARTITION BY nation ORDER BY x ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY nation) AS c FROM kw)
SELECT nation, p, min(x) AS quantile FROM c, (SELECT unnest([0.1::DOUBLE, 0.5, 0.9]) AS p) WHERE c >= p - 1e-12 GROUP BY ALL""")
def weighted_quantile(t):
    """W12"""
    return S.weighted_quantiles(weights(t), ["nation"], "x", "w", [0.1, 0.5, 0.9])


CRPS = WEIGHTS + """, o AS (SELECT nation, arg_max(x, yr) AS obs FROM y GROUP BY nation), cr AS (SELECT a.nation, sum(a.w * abs(a.x - obs)) - 0.5 * any_value(s) AS crps FROM kw a JOIN o USING (nation) JOIN (SELECT a.nation, sum(a.w * b.w * abs(a.x - b.x)) AS s FROM kw a JOIN kw b USING (nation) GROUP BY a.nation) USING (nation) GROUP BY a.nation)"""


def scored(t):
    rows = weights(t)
    last = yearly(t).groupBy("nation").agg(F.max_by("x", "yr").alias("obs"))
    return rows.join(last, "nation")


@query(CRPS + " SELECT nation, round(crps, 7) AS crps FROM cr")
def crps_empirical(t):
    """Score of a weighted ensemble in one sorted pass, against the double sum in SQL."""
    return S.empirical_crps(scored(t), ["nation"], "x", "w", "obs").select("nation", F.round("crps", 7).alias("crps"))


@query(CRPS + " SELECT nation, round(sum(w) FILTER (WHERE x <= obs) / sum(w), 8) AS pit, round(coalesce(sum(w) FILTER (WHERE x > 10), 0) / sum(w), 8) AS prob_above FROM kw JOIN o USING (nation) GROUP BY nation")
def pit(t):
    """The ensemble's distribution function at the observation."""
    w = F.col("w")
    part = lambda on: F.coalesce(F.sum(F.when(on, w)), F.lit(0.0)) / F.sum(w)
    return scored(t).groupBy("nation").agg(F.round(part(F.col("x") <= F.col("obs")), 8).alias("pit"), F.round(part(F.col("x") > 10), 8).alias("prob_above"))


@query(MEMBERS + " SELECT nation, round(regr_intercept(x, z) + 10 * regr_slope(x, z), 6) AS mean, round(sqrt(regr_syy(x, z) * (1 - corr(x, z) ** 2) / (count(*) - 2)), 5) AS sd FROM y GROUP BY nation")
def linear_fc(t):
    """Linear forecast at 10 orders."""
    sd = F.sqrt(F.regr_syy("x", "z") * (1 - F.pow(F.corr("x", "z"), 2)) / (F.count("*") - 2))
    return yearly(t).groupBy("nation").agg(F.round(F.regr_intercept("x", "z") + 10 * F.regr_slope("x", "z"), 6).alias("mean"), F.round(sd, 5).alias("sd"))


HIND = MEMBERS + """, p AS (SELECT a.nation, a.yr, a.x AS obs, a.z, b.x AS member, abs(b.z - a.z) AS d FROM y a JOIN y b ON a.nation = b.nation AND b.yr < a.yr WHERE a.yr >= 1998),
m AS (SELECT nation, yr, z, obs, 'climatology' AS method, member FROM p UNION ALL SELECT nation, yr, z, obs, 'analog', member FROM (SELECT *, row_number() OVER (PARTITION BY nation, yr ORDER BY d, member) AS k FROM p) WHERE k <= 2),
c AS (SELECT *, row_number() OVER (PARTITION BY nation, yr, method ORDER BY member) AS i, count(*) OVER (PARTITION BY nation, yr, method) AS n FROM m),
s AS (SELECT nation, yr, z, obs, method, avg(member) AS mean, avg(abs(member - obs)) - sum(member * (2.0 * i - n - 1)) / any_value(n) ** 2 AS crps FROM c GROUP BY ALL)"""


def hindcast(t):
    """For each nation and year from 1998 on, members are the earlier years; all targets in one plan."""
    rows = yearly(t)
    target = rows.where("yr >= 1998").select("nation", "yr", F.col("x").alias("obs"), "z")
    past = rows.select("nation", F.col("yr").alias("__y"), F.col("x").alias("member"), F.col("z").alias("__z"))
    pairs = target.join(past, "nation").where("__y < yr").withColumn("d", F.abs(F.col("__z") - F.col("z")))
    both = pairs.withColumn("method", F.lit("climatology")).unionByName(R.top_k(pairs, ["nation", "yr"], 2, F.col("d"), F.col("member")).drop("rank").withColumn("method", F.lit("analog")))
    keys = ["nation", "yr", "z", "obs", "method"]
    score = S.empirical_crps(both.withColumn("w", F.lit(1.0)), keys, "member", "w", "obs")
    return score.join(both.groupBy(*keys).agg(F.avg("member").alias("mean")), keys)


@query(HIND + " SELECT nation, yr, method, round(mean, 8) AS mean, round(obs, 6) AS observed, round(crps, 12) AS crps FROM s")
def hindcasts(t):
    """M49 M36 T7"""
    return hindcast(t).select("nation", "yr", "method", F.round("mean", 8).alias("mean"), F.round("obs", 6).alias("observed"), F.round("crps", 12).alias("crps"))


@query(HIND + """, g AS (SELECT *, unnest(list_filter(['all', CASE WHEN z >= 10 THEN 'high' END, CASE WHEN z >= 11 THEN 'very_high' END, CASE WHEN z <= 9 THEN 'low' END, CASE WHEN abs(z - 10) < 1 THEN 'neutral' END], lambda x: x IS NOT NULL)) AS subset FROM s),
a AS (SELECT subset, method, count(*) AS winters, avg(crps) AS crps FROM g GROUP BY ALL)
SELECT a.subset, a.method, a.winters, round(a.crps, 6) AS crps, round(1 - a.crps / b.crps, 6) AS crpss FROM a JOIN a b ON a.subset = b.subset AND b.method = 'climatology'""")
def skill_scores(t):
    """Skill against climatology in overlapping subsets of the targets."""
    z = F.col("z")
    labels = F.array_compact(F.array(F.lit("all"), F.when(z >= 10, "high"), F.when(z >= 11, "very_high"), F.when(z <= 9, "low"), F.when(F.abs(z - 10) < 1, "neutral")))
    rows = hindcast(t).withColumn("subset", F.explode(labels)).groupBy("subset", "method").agg(F.count("*").alias("winters"), F.avg("crps").alias("c"))
    base = F.max(F.when(F.col("method") == "climatology", F.col("c"))).over(Window.partitionBy("subset"))
    return rows.select("subset", "method", "winters", F.round("c", 6).alias("crps"), F.round(S.skill(F.col("c"), base), 6).alias("crpss"))


RESAMPLES = 499
#: A resample's pick for each place: a number under n from a digest.
PICK_SQL = "CAST(('0x' || substr(md5(rep || ':' || place), 1, 8))::BIGINT % n AS BIGINT) + 1"


def resampled(rows, keys: list[str], order: str):
    """rows with rep and place for each resample: every place of a group takes a drawn row of it."""
    own = Window.partitionBy(*keys)
    placed = rows.withColumn("place", F.row_number().over(own.orderBy(order))).withColumn("n", F.count("*").over(own))
    spots = placed.select(*keys, "n", "place", F.explode(F.sequence(F.lit(1), F.lit(RESAMPLES))).alias("rep"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "place")), 1, 8), 16, 10).cast("long") % F.col("n") + 1
    return spots.select(*keys, "rep", pick.cast("int").alias("place")).join(placed, [*keys, "place"])


@query(HIND + f""", wide AS (SELECT nation, yr, max(crps) FILTER (WHERE method = 'analog') AS a, max(crps) FILTER (WHERE method = 'climatology') AS c FROM s GROUP BY ALL),
pl AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY yr) AS place, count(*) OVER (PARTITION BY nation) AS n FROM wide WHERE a IS NOT NULL AND c IS NOT NULL),
dr AS (SELECT nation, rep, {PICK_SQL} AS place FROM pl, range(1, {RESAMPLES + 1}) x(rep)),
sk AS (SELECT nation, rep, n, 1 - avg(a) / avg(c) AS skill FROM dr JOIN pl USING (nation, place) GROUP BY ALL)
SELECT nation, any_value(n) AS winters, round(quantile_cont(skill, 0.05), 6) AS lo, round(quantile_cont(skill, 0.95), 6) AS hi FROM sk GROUP BY nation""")
def skill_interval(t):
    """Paired bootstrap interval of the analog's skill."""
    wide = hindcast(t).groupBy("nation", "yr").pivot("method", ["climatology", "analog"]).agg(F.first("crps")).dropna()
    skills = resampled(wide, ["nation"], "yr").groupBy("nation", "rep", "n").agg(S.skill(F.avg("analog"), F.avg("climatology")).alias("skill"))
    return skills.groupBy("nation").agg(F.first("n").alias("winters"), F.round(F.percentile("skill", F.lit(0.05)), 6).alias("lo"), F.round(F.percentile("skill", F.lit(0.95)), 6).alias("hi"))


@query()
def predictive_mixture(t):
    """A Gaussian mixture around the weighted members, its quantiles and score."""

    def one(g, rng):
        got = D.summary(g["x"].to_numpy(), g["w"].to_numpy(), 0.5, float(g["obs"].iloc[0]))
        return {k: got[k] for k in ("mean", "lo", "median", "hi", "prob_above", "crps", "pit", "covered")}

    return S.grouped(scored(t).select("nation", "yr", "x", "w", "obs"), ["nation"], "nation string, mean double, lo double, median double, hi double, prob_above double, crps double, pit double, covered boolean", one, order=["yr"])


@query()
def load_model(t):
    """Log monthly value on two drivers with year and month effects, billing weight by least error."""
    w = Window.partitionBy("nation").orderBy("month")
    rows = monthly(t).withColumn("y", F.ln(F.col("v") / C.days_in_month(F.col("month"))))
    drivers = {}
    for k, weight in enumerate((0.0, 0.25, 0.5, 0.75)):
        drivers[weight] = (f"h{k}", f"c{k}")
        before = F.when(F.lag("month").over(w) == F.add_months("month", -1), F.lag("n").over(w))  # the month before, not the row before
        blended = weight * before + (1 - weight) * F.col("n")
        rows = rows.withColumn(f"h{k}", blended).withColumn(f"c{k}", blended % 4)
    rows = rows.withColumn("year", F.year("month")).withColumn("mo", F.month("month"))

    def fit(g, rng):
        got = D.load_fit(g.rename(columns={"mo": "month_no"}).assign(month=g["mo"]), "y", drivers, lags=12)
        return [] if got is None else {k: float(got[k]) for k in ("billing_weight", "heating", "heating_se", "cooling", "cooling_se", "r2")} | {"months": got["n"]}

    names = ["nation", "year", "mo", "y", *[c for pair in drivers.values() for c in pair]]
    return S.grouped(rows.select(names), ["nation"], "nation string, billing_weight double, heating double, heating_se double, cooling double, cooling_se double, r2 double, months long", fit, order=["year", "mo"])


@query()
def teleconnection(t):
    """Rank correlation with surrogate-based p for each month and lead, then FDR over all."""
    rows = monthly(t)
    index = total(t).select("month", F.col("v").alias("x"))
    leads = F.explode(F.array(*map(F.lit, range(3)))).alias("lead")
    each = rows.select("nation", "month", "v", leads).join(F.broadcast(index.withColumnRenamed("month", "at")), F.expr("at = add_months(month, -lead)")).select(F.month("month").cast("long").alias("mo"), "lead", F.year("month").alias("year"), "nation", "v", "x")

    def test(g, rng):
        cube = g.pivot(index="year", columns="nation", values="v").dropna()
        if len(cube) < 4:
            return []
        x = g.groupby("year")["x"].first().loc[cube.index].to_numpy()
        r, p = S.field_test(x, cube.to_numpy(), 199, rng)
        return [{"nation": n, "n": len(cube), "r": a, "p": b} for n, a, b in zip(cube.columns, r, p, strict=True)]

    found = S.grouped(each, ["mo", "lead"], "mo long, lead int, nation string, n long, r double, p double", test, seed=7, order=["year", "nation"])
    return S.with_q(found, "p").withColumn("significant", F.col("q") <= 0.1)


def profiles(t):
    """nation, year, mo, v: what nations are clustered by."""
    return monthly(t).select("nation", F.year("month").alias("year"), F.month("month").alias("mo"), "v")


def ranked_profile(rows) -> tuple[list[str], np.ndarray]:
    """Names and the ranks of their mean months, from rows (nation, mo, v) as pandas."""
    wide = rows.pivot_table(index="nation", columns="mo", values="v", aggfunc="mean").reindex(columns=range(1, 13)).fillna(0)
    return list(wide.index), S.standard_ranks(wide.to_numpy())


MOST_UNITS, MOST_CLUSTERS, REPLICATES = 5_000, 5, 50


def replicates(t):
    """rep, nation, mo, v, times: 0 is the data as they are, the others have years drawn with replacement."""
    years = profiles(t).select("year").distinct().withColumn("place", F.row_number().over(Window.orderBy("year"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "place")), 1, 8), 16, 10).cast("long") % F.col("n") + 1
    draws = years.select("n", "place", F.explode(F.sequence(F.lit(1), F.lit(REPLICATES))).alias("rep")).select("rep", pick.cast("int").alias("place"))
    drawn_years = draws.groupBy("rep", "place").agg(F.count("*").alias("times")).join(years.select("place", "year"), "place").select("rep", "year", "times")
    every = years.select(F.lit(0).alias("rep"), "year", F.lit(1).cast("long").alias("times")).unionByName(drawn_years)
    return profiles(t).join(F.broadcast(every), "year").groupBy("rep", "nation", "mo").agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("v"))


def clusterings(t, only: int | None = None):
    """rep (one of them with `only`), nation, k, cluster, silhouette: Ward's clustering of the nations for each replicate and k.

    A replicate is a group. Units are a dimension (here nations); more than MOST_UNITS of them are an error.
    """

    def cluster(g, rng):
        names, points = ranked_profile(g)
        if len(names) > MOST_UNITS:
            raise ValueError(f"{len(names)} units are too many for a hierarchy")
        distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
        out = []
        merges = N.ward_merges(points)
        for k in range(2, min(MOST_CLUSTERS, len(names) - 1) + 1):
            label = N.cut_merges(merges, len(points), k)
            score = float(N.silhouette(distance, label).mean())
            out += [{"nation": n, "k": k, "cluster": int(c), "silhouette": score} for n, c in zip(names, label, strict=True)]
        return out

    drawn_from = replicates(t) if only is None else replicates(t).where(F.col("rep") == only)
    return S.grouped(drawn_from, ["rep"], "rep int, nation string, k int, cluster int, silhouette double", cluster, order=["nation", "mo"])


@query()
def cluster_scores(t):
    """For each k the silhouette, and how well clusterings of resampled years agree with it (adjusted Rand)."""
    rows = written(clusterings(t), "clusterings")
    real = rows.where("rep = 0").select("k", "silhouette")
    stable = N.agreement(rows, "nation").groupBy("k").agg(F.avg("ari").alias("stability"), F.percentile("ari", F.lit(0.1)).alias("stability_p10"))
    scores = real.groupBy("k").agg(F.first("silhouette").alias("silhouette")).join(stable, "k")
    best = F.row_number().over(Window.orderBy(F.round("silhouette", 12).desc(), "k")) == 1
    return scores.withColumn("chosen", best)


@query()
def ward_clusters(t):
    """Nations by their monthly profile, k by silhouette, then the smaller k."""
    real = clusterings(t, only=0).drop("rep")
    best = F.max(F.struct(F.round("silhouette", 12).alias("s"), (-F.col("k")).alias("k"))).over(Window.partitionBy())
    return real.withColumn("b", best).where(F.col("k") == -F.col("b.k")).select("nation", "cluster", "k", "silhouette")


def trajectories(t):
    """nation, year, a: the values of each complete year, in millions."""
    path = monthly(t).groupBy("nation", F.year("month").alias("year")).agg(F.array_sort(F.collect_list(F.struct("month", "v"))).alias("p")).where(F.size("p") == 12)
    return path.select("nation", "year", F.transform("p", lambda x: x["v"] / 1e6).alias("a"))


LEAST_FAMILY, MOST_FAMILIES = 3, 4


@query()
def event_families(t):
    """Each nation's yearly trajectories by time warping and k-medoids.

    k by silhouette, then the smaller one, among those whose families have LEAST_FAMILY members or more;
    families are named from A by their mean peak. A nation's years are a group, and their distances
    come from a join by nation.
    """
    rows = trajectories(t)
    one, two = (rows.select("nation", F.col("year").alias(y), F.col("a").alias(a)) for y, a in (("year", "a"), ("other", "b")))
    table = one.join(two, "nation").select("nation", "year", "other", F.array_max("a").alias("peak"), N.warping(2)("a", "b").alias("d"))

    def families(g, rng):
        distance = g.pivot(index="year", columns="other", values="d").to_numpy()
        peak, years = g.groupby("year")["peak"].first().to_numpy(), sorted(g["year"].unique())
        best = None
        for k in range(2, min(MOST_FAMILIES, len(years) // LEAST_FAMILY) + 1):
            centre, label, _ = N.medoids(distance, k, rng)
            if np.bincount(label, minlength=k).min() < LEAST_FAMILY:
                continue
            score = N.silhouette(distance, label)
            if best is None or score.mean() > best[2].mean() + 1e-12:
                best = (centre, label, score)
        if best is None:
            return []
        centre, label, score = best
        order = np.argsort([-peak[label == c].mean() for c in range(len(centre))], kind="stable")
        name = {c: chr(ord("A") + k) for k, c in enumerate(order)}
        return [{"year": int(y), "family": name[f], "is_medoid": i in centre, "silhouette": float(v)} for i, (y, f, v) in enumerate(zip(years, label, score, strict=True))]

    return S.grouped(table, ["nation"], "nation string, year int, family string, is_medoid boolean, silhouette double", families, seed=5, order=["year", "other"])


@query()
def nearest_family(t):
    """The family of whose medoid a nation's latest complete year is nearest by time warping."""
    rows = written(trajectories(t), "trajectories")
    middle = event_families(t).where("is_medoid").join(rows, ["nation", "year"]).select("nation", "family", F.col("year").alias("medoid"), F.col("a").alias("b"))
    latest = rows.groupBy("nation").agg(F.max("year").alias("year"), F.max_by("a", "year").alias("a"))
    near = latest.join(middle, "nation").withColumn("d", N.warping(2)("a", "b"))
    return near.groupBy("nation", "year").agg(F.min_by(F.struct("family", "medoid", "d"), F.struct("d", "family")).alias("x")).select("nation", "year", "x.family", "x.medoid", F.round("x.d", 9).alias("distance"))


def permuted_correlation(rows, keys: list[str], order: str, x: str, y: str, shuffles: int = SHUFFLES):
    """keys, r, p: the correlation of x and y, and how often shuffles of x reach it, (1 + hits) / (shuffles + 1)."""
    own = Window.partitionBy(*keys)
    placed = rows.withColumn("place", F.row_number().over(own.orderBy(order)))
    moved = shuffled(placed.select(*keys, F.col(order).alias("__o"), F.col(x).alias("__x")), 0, shuffles)
    at = F.when(F.col("rep") == 0, F.row_number().over(Window.partitionBy(*keys, "rep").orderBy("__o"))).otherwise(F.row_number().over(Window.partitionBy(*keys, "rep").orderBy(drawn(F.col("__o").cast("string")), "__o")))
    both = moved.withColumn("place", at).select(*keys, "rep", "place", "__x").join(placed.select(*keys, "place", F.col(y).alias("__y")), [*keys, "place"])
    r = both.groupBy(*keys, "rep").agg(F.corr("__x", "__y").alias("r"))
    real = F.max(F.when(F.col("rep") == 0, F.col("r"))).over(own)
    reached = F.count_if((F.col("rep") > 0) & (F.abs("r") >= F.abs("real") - 1e-9))
    return r.withColumn("real", real).groupBy(*keys).agg(F.first("real").alias("r"), ((1 + reached) / F.lit(shuffles + 1.0)).alias("p")).where(F.col("r").isNotNull() & ~F.isnan("r"))


def permuted_sql(source: str, keys: str, order: str, x: str, y: str) -> str:
    """The CTE pt (keys, r, p) of permuted_correlation() over a CTE."""
    return f"""pa AS (SELECT {keys}, {y} AS y, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS place FROM {source}),
pb AS (SELECT {keys}, rep, {x} AS x, CASE WHEN rep = 0 THEN row_number() OVER (PARTITION BY {keys}, rep ORDER BY {order}) ELSE row_number() OVER (PARTITION BY {keys}, rep ORDER BY {DRAW_SQL.format(key=order)}, {order}) END AS place FROM {source}, range(0, {SHUFFLES + 1}) x(rep)),
pr AS (SELECT {keys}, rep, CASE WHEN min(x) = max(x) OR min(y) = max(y) THEN NULL ELSE corr(x, y) END AS r FROM pa JOIN pb USING ({keys}, place) GROUP BY {keys}, rep),
ps AS (SELECT *, max(r) FILTER (WHERE rep = 0) OVER (PARTITION BY {keys}) AS real FROM pr),
pt AS (SELECT {keys}, any_value(real) AS r, (1 + count(*) FILTER (WHERE rep > 0 AND abs(r) >= abs(real) - 1e-9)) / {SHUFFLES + 1}.0::DOUBLE AS p FROM ps GROUP BY {keys} HAVING any_value(real) IS NOT NULL)"""


@query(MEMBERS + ", " + permuted_sql("y", "nation", "yr", "x", "z") + f""", pl AS (SELECT nation, x, row_number() OVER (PARTITION BY nation ORDER BY yr) AS place, count(*) OVER (PARTITION BY nation) AS n FROM y),
dr AS (SELECT nation, rep, {PICK_SQL} AS place FROM pl, range(1, {RESAMPLES + 1}) x(rep)), mn AS (SELECT nation, rep, avg(x) AS m FROM dr JOIN pl USING (nation, place) GROUP BY ALL),
iv AS (SELECT nation, round(quantile_cont(m, 0.05), 6) AS lo, round(quantile_cont(m, 0.95), 6) AS hi FROM mn GROUP BY nation),
q AS (SELECT *, row_number() OVER (ORDER BY p, nation) AS place, count(*) OVER () AS m FROM pt)
SELECT nation, round(r, 6) AS r, round(p, 6) AS p, round(least(1.0, min(p * m / place) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q, lo, hi FROM q JOIN iv USING (nation)""")
def permutation_test(t):
    """Correlation of value and orders with a permutation p, and a bootstrap interval of the mean; BH over nations."""
    rows = yearly(t)
    tested = S.with_q(permuted_correlation(rows, ["nation"], "yr", "x", "z"), "p")
    means = resampled(rows.select("nation", "yr", "x"), ["nation"], "yr").groupBy("nation", "rep").agg(F.avg("x").alias("m"))
    interval = means.groupBy("nation").agg(F.round(F.percentile("m", F.lit(0.05)), 6).alias("lo"), F.round(F.percentile("m", F.lit(0.95)), 6).alias("hi"))
    return tested.join(interval, "nation").select("nation", F.round("r", 6).alias("r"), F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), "lo", "hi")
