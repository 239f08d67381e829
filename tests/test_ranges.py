"""Running aggregates and q-values over ranges: keys and ties of any size."""

import random

import pytest
from pyspark.sql import functions as F

from thermocline.operators import relational as R
from thermocline.operators import stats as S



@pytest.fixture(autouse=True)
def parts(spark):
    """Small tables, too, are dealt over all parts."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


ROWS = [("hot" if i % 3 else None if i % 5 == 0 else f"k{i % 7}", None if i % 11 == 0 else (i * 37) % 50, i) for i in range(600)]


@pytest.mark.parametrize("later", [False, True])
def test_scanned_runs_over_parts(spark, later):
    rows = spark.createDataFrame(ROWS, "k string, v int, i int").repartition(6)
    order = [F.col("v").asc_nulls_first(), F.col("i").desc()]
    got = R.scanned(rows, ["k"], order, later, total=("sum", F.col("i")), low=("min", F.col("v")), high=("max", F.col("v"))).collect()
    assert len(got) == len(ROWS)
    want = {}
    for k in {r[0] for r in ROWS}:
        own = sorted([r for r in ROWS if r[0] == k], key=lambda r: (r[1] is not None, r[1] or 0, -r[2]))
        for n, r in enumerate(own):
            seen = own[n:] if later else own[: n + 1]
            known = [x[1] for x in seen if x[1] is not None]
            want[r[2]] = (sum(x[2] for x in seen), min(known, default=None), max(known, default=None))
    assert {r.i: (r.total, r.low, r.high) for r in got} == want


def test_dealt_cuts_one_key_and_ties(spark):
    parts = R.dealt(spark.range(4000).select(F.lit("a").alias("k"), F.lit(1).alias("v")).repartition(4), ["k"], [F.col("v")])
    assert parts.select("__part").distinct().count() > 1
    assert R.running(parts, ["k"], [F.col("v")], n=("sum", F.lit(1))).select("n").distinct().count() == 4000
    assert R.scanned(spark.createDataFrame([], "k string, v int"), ["k"], [F.col("v")], n=("sum", F.lit(1))).count() == 0


def plain_q(p, scale):
    m = len(p)
    out, least = {}, 1.0
    for rank, (value, key) in reversed(list(enumerate(sorted((v, k) for k, v in p.items()), 1))):
        least = min(least, value * m * scale / rank)
        out[key] = least
    return out


@pytest.mark.parametrize("method", ["bh", "by"])
@pytest.mark.parametrize("keys", [None, ["g"]])
def test_q_values_over_range_borders(spark, method, keys):
    draw = random.Random(4)
    rows = [(i, "big" if i % 4 else "small" if i % 8 else None, None if i % 13 == 0 else round(draw.random() ** 3, 2)) for i in range(3000)]  # many ties
    found = S.with_q(spark.createDataFrame(rows, "i int, g string, p double").repartition(5), "p", keys, method)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan or keys is None and plan.count("SinglePartition") <= 2  # a row for each part, and the count
    got = {r.i: r.q for r in found.collect()}
    for g in {r[1] for r in rows} if keys else {0}:
        own = {r[0]: r[2] for r in rows if (not keys or r[1] == g)}
        tested = {k: v for k, v in own.items() if v is not None}
        scale = sum(1 / k for k in range(1, len(tested) + 1)) if method == "by" else 1
        want = plain_q(tested, scale)
        assert all(got[k] is None if v is None else got[k] == pytest.approx(want[k], abs=1e-12) for k, v in own.items())


def test_harmonic_sum(spark):
    got = spark.range(1, 5001).select("id", S.harmonic(F.col("id")).alias("h")).collect()
    total = 0.0
    for r in got:
        total += 1 / r.id
        assert r.h == pytest.approx(total, abs=1e-11)
