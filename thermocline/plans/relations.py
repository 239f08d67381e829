"""Queries on rows: predicates, set operations, parsing, sorting, deduplication, quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermocline.functions import columns as C
from thermocline.operators import quality as Q
from thermocline.operators import relational as R
from thermocline.plans.registry import MONTHLY, UNITS, monthly, nations, query, units


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice IS NOT NULL")
def range_membership(t):
    """Pushed down to the scan."""
    when = F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-03-31").cast("timestamp_ntz"))
    return t.orders.where(when & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).dropna(subset=["o_totalprice"]).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n, sum(CASE WHEN abs(l_discount - 0.05) < 1e-6 THEN 0 ELSE 1 END)::BIGINT AS kept FROM lineitem")
def sentinel_null(t):
    """a sentinel value becomes null."""
    return t.lineitem.select(C.null_if_sentinel(F.col("l_discount"), 0.05).alias("d")).agg(F.count("*").alias("n"), F.count("d").alias("kept"))


@query("SELECT p_partkey, round(p_retailprice / nullif(p_size % 5, 0), 4) + 0.0 AS ratio FROM part")
def safe_ratio(t):
    """Null instead of a division by zero, rounded."""
    return t.part.select("p_partkey", C.rounded(F.try_divide(F.col("p_retailprice"), F.col("p_size") % 5), 4).alias("ratio"))


@query("SELECT n_name AS nation, count(*) AS customers FROM nation JOIN customer c ON n_nationkey = c_nationkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY n_name")
def anti_join(t):
    """Customers without an urgent order, by nation."""
    idle = t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return idle.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("customers"))


@query("SELECT r_name AS region, m::BIGINT AS month_no, l::BIGINT AS lead FROM region, range(1, 13) a(m), range(0, 7) b(l)")
def cross_grid(t):
    """The target grid of regions, months and leads."""
    grid = t.region.select(F.col("r_name").alias("region"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("month_no"))
    return grid.withColumn("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))


@query(f"WITH {MONTHLY} SELECT month FROM monthly WHERE region = 'ASIA' INTERSECT SELECT month FROM monthly WHERE region = 'EUROPE' EXCEPT SELECT month FROM monthly WHERE region = 'AFRICA' AND year(month) = 1997")
def set_operations(t):
    """T8 T9"""
    rows = monthly(t)
    of = lambda on: rows.where(on).select("month")
    return of(F.col("region") == "ASIA").intersect(of(F.col("region") == "EUROPE")).subtract(of((F.col("region") == "AFRICA") & (F.year("month") == 1997)))


@query(f"WITH {UNITS} SELECT kind, unit, month, v, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY v DESC, unit, month) AS rank FROM units) WHERE rank <= 5")
def top_months(t):
    """The five largest months of each kind of unit."""
    return R.top_k(units(t), ["kind"], 5, F.desc("v"), F.col("unit"), F.col("month")).select("kind", "unit", "month", "v", "rank")


@query("SELECT r_name AS region, string_agg(n_name, ' ' ORDER BY n_name) AS states, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def ordered_strings(t):
    """A11"""
    return nations(t).groupBy("region").agg(R.ordered_list(F.col("nation")).alias("states"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, max(hash) AS hash FROM (SELECT l_orderkey, l_linenumber, first_value(h) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, h DESC) AS hash FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) * 1000 + l_suppkey AS h FROM lineitem)) GROUP BY ALL")
def dedupe_keep_last(t):
    """The last row of each key in a total order."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", (F.round(F.col("l_extendedprice") * 100).cast("long") * 1000 + F.col("l_suppkey")).alias("hash"))
    return R.keep_last(rows, ["l_orderkey", "l_linenumber"], F.desc("l_shipdate"), F.desc("hash")).select("l_orderkey", "l_linenumber", "hash")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def overlap_guard(t):
    """Keys that occur more than once."""
    return Q.repeated(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""WITH n AS (SELECT DISTINCT p_brand || ' ' || p_type AS raw FROM part), p AS (SELECT raw, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS s FROM n)
SELECT raw, CASE WHEN contains(s, 'brand1') THEN 'ONE' WHEN contains(s, 'brand2') THEN 'TWO' WHEN contains(s, 'promo') THEN 'PROMO' WHEN contains(s, 'brand') THEN 'OTHER' END AS hub FROM p""")
def canonical_names(t):
    """Ordered begins-or-contains rules on the plain name."""
    names = t.part.select(F.concat_ws(" ", "p_brand", "p_type").alias("raw")).distinct()
    return names.select("raw", C.canonical_name(F.col("raw"), [("brand1", "ONE"), ("brand2", "TWO"), ("promo", "PROMO"), ("brand", "OTHER")]).alias("hub"))


@query(r"""SELECT event_id, CAST(list_aggregate(list_transform(regexp_extract_all(props, '-?\d+'), lambda x: CAST(x AS BIGINT)), 'sum') AS BIGINT) AS total, CAST(len(regexp_extract_all(props, '-?\d+')) AS BIGINT) AS n FROM events""")
def regex_parse(t):
    """All numbers of a text field by pattern."""
    found = F.transform(F.regexp_extract_all("props", F.lit(r"-?\d+"), F.lit(0)), lambda x: x.cast("long"))
    total = F.when(F.size(found) > 0, F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x))
    return t.events.select("event_id", total.alias("total"), F.size(found).cast("long").alias("n"))


@query("UNPIVOT (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) ON size, price INTO NAME variable VALUE value")
def unpivot_grid(t):
    """Columns to rows."""
    return R.melted(t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")), ["p_partkey"], ["size", "price"])


@query("""SELECT season, month_no FROM (VALUES ('DJF', 1), ('JFM', 2), ('FMA', 3), ('MAM', 4), ('AMJ', 5), ('MJJ', 6), ('JJA', 7), ('JAS', 8), ('ASO', 9), ('SON', 10), ('OND', 11), ('NDJ', 12), ('XYZ', NULL)) v(season, month_no)""")
def season_months(t):
    """S4"""
    rows = t._spark.createDataFrame([(s,) for s in (*C.SEASONS, "XYZ")], "season string")
    return rows.select("season", C.season_month(F.col("season")).alias("month_no"))


@query("SELECT event_type AS kind, date_trunc('day', ts)::DATE AS day, count(*) AS n, round(avg(value), 8) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def daily_events(t):
    """A4 A14"""
    return t.events.groupBy(F.col("event_type").alias("kind"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"), F.countDistinct("user_id").alias("users"))


@query("SELECT o_orderstatus AS status, round(avg((o_totalprice > 100000)::INT), 8) AS coverage, count(*) FILTER (WHERE o_totalprice > 100000) AS hits FROM orders GROUP BY ALL")
def coverage_rate(t):
    """A15"""
    hit = F.col("o_totalprice") > 100000
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.round(F.avg(hit.cast("int")), 8).alias("coverage"), F.count_if(hit).alias("hits"))


PHASES = f"""WITH {MONTHLY}, p AS (SELECT region, v, CASE WHEN month(month) IN (12, 1, 2) THEN 'cold' WHEN month(month) BETWEEN 6 AND 8 THEN 'warm' ELSE 'neutral' END AS phase FROM monthly)"""


@query(PHASES + """ SELECT region, count(*) FILTER (WHERE phase = 'cold') AS cold_n, round(avg(v) FILTER (WHERE phase = 'cold'), 4) AS cold_mean, count(*) FILTER (WHERE phase = 'warm') AS warm_n, round(avg(v) FILTER (WHERE phase = 'warm'), 4) AS warm_mean, count(*) FILTER (WHERE phase = 'neutral') AS neutral_n, round(avg(v) FILTER (WHERE phase = 'neutral'), 4) AS neutral_mean FROM p GROUP BY region""")
def phase_stats(t):
    """Count and mean by phase, as columns."""
    m = F.month("month")
    rows = monthly(t).withColumn("phase", F.when(m.isin(12, 1, 2), "cold").when(m.between(6, 8), "warm").otherwise("neutral"))
    wide = [f(F.when(F.col("phase") == p, F.col("v"))) for p in ("cold", "warm", "neutral") for f in (F.count, lambda c: F.round(F.avg(c), 4))]
    names = [f"{p}_{k}" for p in ("cold", "warm", "neutral") for k in ("n", "mean")]
    return rows.groupBy("region").agg(*[c.alias(n) for c, n in zip(wide, names, strict=True)])


@query("""WITH m AS (SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT r_name, count(*)::DOUBLE / sum(count(*)) OVER () AS w FROM m GROUP BY r_name)
SELECT 'customers_have_nations' AS name, 'error' AS severity, count(*) FILTER (WHERE n_name IS NULL) = 0 AS passed FROM m
UNION ALL SELECT 'orders_have_customers', 'error', count(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'weights_sum_to_one', 'error', abs(sum(w) - 1) < 1e-9 FROM s
UNION ALL SELECT 'months_complete', 'error', count(DISTINCT date_trunc('month', o_orderdate)) = date_diff('month', min(o_orderdate), max(o_orderdate)) + 1 FROM orders
UNION ALL SELECT 'prices_in_range', 'error', avg((o_totalprice BETWEEN 0 AND 1000000)::INT) >= 0.999 FROM orders
UNION ALL SELECT 'discounts_in_range', 'error', avg((l_discount BETWEEN 0 AND 0.2)::INT) >= 0.999 FROM lineitem
UNION ALL SELECT 'line_keys_unique', 'warn', count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
UNION ALL SELECT 'shipped_after_order', 'warn', avg((l_shipdate >= o_orderdate)::INT) >= 0.99 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def quality_checks(t):
    """The check kinds of the quality stage as one table."""
    month = F.trunc("o_orderdate", "month")
    found = [
        Q.no_orphans(t.customer, t.nation, "c_nationkey", "n_nationkey", "customers_have_nations"),
        Q.no_orphans(t.orders, t.customer, "o_custkey", "c_custkey", "orders_have_customers"),
        Q.sums_to_one(R.shares(t.customer.join(F.broadcast(nations(t)), F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn("one", F.lit(1)), "region", "one"), "share", "weights_sum_to_one"),
        Q.check(t.orders, F.countDistinct(month) == F.months_between(F.max(month), F.min(month)) + 1, "months_complete"),
        Q.mostly(t.orders, F.col("o_totalprice").between(0, 1000000), 0.999, "prices_in_range"),
        Q.mostly(t.lineitem, F.col("l_discount").between(0, 0.2), 0.999, "discounts_in_range"),
        Q.check(t.lineitem, F.count("*") == F.countDistinct("l_orderkey", "l_linenumber"), "line_keys_unique", "warn"),
        Q.mostly(t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")), F.col("l_shipdate") >= F.col("o_orderdate"), 0.99, "shipped_after_order", "warn"),
    ]
    return reduce(DataFrame.unionByName, found).select("name", "severity", "passed")


@query(f"""WITH {MONTHLY} SELECT nation, month, round(v / (SELECT max(v) FROM monthly x WHERE x.nation = m.nation) , 8) AS share_of_peak, CASE WHEN v >= 2e6 THEN 'PASS' WHEN v >= 1e6 THEN 'WARN' ELSE 'FAIL' END AS status FROM monthly m""")
def view_status(t):
    """The view projections: a status by conditions and a share of the group's peak."""
    v = F.col("v")
    return monthly(t).select("nation", "month", F.round(v / F.max("v").over(Window.partitionBy("nation")), 8).alias("share_of_peak"), F.when(v >= 2e6, "PASS").when(v >= 1e6, "WARN").otherwise("FAIL").alias("status"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_cents, round(avg(l_discount), 8) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def pricing_summary(t):
    """The scan-heavy aggregate: filter pushed down, six columns read, partial sums."""
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.round("l_quantity").cast("long")).alias("sum_qty"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("sum_cents"), F.round(F.avg("l_discount"), 8).alias("avg_disc"), F.count("*").alias("count_order"))
