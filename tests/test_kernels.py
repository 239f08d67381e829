import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thermocline.operators import mining as N
from thermocline.operators import models as D
from thermocline.operators import relational as R
from thermocline.operators import stats as S


def plain_dtw(a, b, band):
    band = max(band, abs(len(a) - len(b)))
    cost = {(-1, -1): 0.0}
    for i, j in itertools.product(range(len(a)), range(len(b))):
        if abs(i - j) <= band:
            cost[i, j] = (a[i] - b[j]) ** 2 + min(cost.get(k, math.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    return math.sqrt(cost[len(a) - 1, len(b) - 1])


series = st.lists(st.floats(-5, 5), min_size=2, max_size=9)


@given(series, series, st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_dtw_equals_plain_recursion(a, b, band):
    assert N.dtw(np.array(a), np.array(b), band) == pytest.approx(plain_dtw(a, b, band), abs=1e-9)


def test_nearest_is_exhaustive_search_and_prunes(spark):
    rng = np.random.default_rng(1)
    pool, asked = rng.normal(size=(80, 8)).cumsum(1), rng.normal(size=(3, 8)).cumsum(1)
    rows = [(q, i, x.tolist(), y.tolist()) for q, x in enumerate(asked) for i, y in enumerate(pool)]
    found = N.nearest(spark.createDataFrame(rows, "q int, i int, qa array<double>, a array<double>"), "q", "i", "qa", "a", 2, 5).collect()
    for q, x in enumerate(asked):
        own = sorted((r for r in found if r["q"] == q), key=lambda r: r["rank"])
        assert [r["i"] for r in own] == sorted(range(80), key=lambda i: (round(plain_dtw(x, pool[i], 2), 9), i))[:5]
    assert all(r["pruned"] > 0 for r in found)


def test_warping_of_ragged_and_missing_arrays(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0, 3.0]), (None, [1.0]), ([], [1.0]), ([1.0], [3.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(N.warping(1)("a", "b")).collect()] == [1.0, None, None, 2.0]


def test_medoids_minimise_over_all_choices():
    rng = np.random.default_rng(12)
    points = rng.normal(size=(12, 2))
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    best = min(distance[:, list(c)].min(1).sum() for c in itertools.combinations(range(12), 3))
    centre, label, cost = N.medoids(distance, 3, np.random.default_rng(0))
    assert cost == pytest.approx(best, rel=0.05) and (np.diff(centre) > 0).all() and (label == distance[:, centre].argmin(1)).all()


def test_fdr_equals_definition(spark):
    p = np.random.default_rng(2).uniform(size=40).round(3)
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i int, p double")
    got = [r["q"] for r in S.with_q(rows, "p").orderBy("i").collect()]
    want = [min(min(1.0, s * 40 / (np.sort(p) <= s).sum()) for s in p if s >= x) for x in p]
    assert got == pytest.approx(want)


def test_crps_of_mixture_is_the_integral():
    mu, w, sigma, y = np.array([0.0, 1.5, -2.0]), np.array([0.2, 0.5, 0.3]), 0.7, 0.4
    x = np.linspace(-12, 12, 40001)
    f = np.array([S.mixture_cdf(mu, w, sigma, v) for v in x])
    assert S.mixture_crps(mu, w, sigma, y) == pytest.approx(np.trapezoid((f - (x >= y)) ** 2, x), abs=1e-3)


def test_quantile_inverts_cdf():
    mu, w = np.array([0.0, 3.0]), np.array([0.4, 0.6])
    for p in (0.1, 0.5, 0.9):
        assert S.mixture_cdf(mu, w, 0.5, S.mixture_quantiles(mu, w, 0.5, [p])[0]) == pytest.approx(p)
    assert S.mixture_quantiles(mu, w, 0, [0.4, 0.5]).tolist() == [0.0, 3.0]


def test_surrogates_keep_the_mean_and_spectrum():
    x = np.random.default_rng(3).normal(size=31) + 4
    made = S.surrogates(x, 5, np.random.default_rng(4))
    assert np.abs(np.fft.rfft(made, axis=1))[:, 1:] == pytest.approx(np.tile(np.abs(np.fft.rfft(x))[1:], (5, 1)))
    assert made.mean(1) == pytest.approx(np.full(5, x.mean()))


def test_field_test_finds_a_planted_link_only():
    rng = np.random.default_rng(5)
    x = rng.normal(size=100)
    y = rng.normal(size=(100, 20))
    y[:, :5] += 2 * x[:, None]
    _, p = S.field_test(x, y, 199, rng)
    assert (p[:5] < 1e-4).all() and (p[5:] > 0.01).mean() > 0.8


def test_robust_errors_equal_the_double_sum():
    rng = np.random.default_rng(13)
    x = np.column_stack([np.ones(40), rng.normal(size=(40, 2))])
    y = x @ [1.0, 2.0, 3.0] + rng.normal(size=40)
    for lags in (0, 4, 60):
        got = D.least_squares(x, y, lags)
        bread = np.linalg.inv(x.T @ x)
        e = y - x @ (bread @ x.T @ y)
        middle = sum(max(0, 1 - abs(i - j) / (lags + 1)) * e[i] * e[j] * np.outer(x[i], x[j]) for i in range(40) for j in range(40))
        assert got["se"] == pytest.approx(np.sqrt(np.diag(bread @ middle @ bread)))


def test_ward_and_silhouette_find_two_groups():
    points = np.vstack([np.random.default_rng(6).normal(size=(8, 2)), np.random.default_rng(7).normal(size=(8, 2)) + 12])
    labels = N.ward(points, 2)
    assert labels.tolist() == [1] * 8 + [2] * 8
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    assert N.silhouette(distance, labels).mean() > 0.8
    assert N.adjusted_rand(labels, N.medoids(distance, 2, np.random.default_rng(0))[1]) == 1.0


def test_load_fit_recovers_planted_response():
    import pandas as pd

    rng = np.random.default_rng(8)
    rows = pd.DataFrame([(y, m) for y in range(2000, 2016) for m in range(1, 13)], columns=["year", "month"])
    heat, cool = rng.uniform(0, 30, len(rows)), rng.uniform(0, 20, len(rows))
    rows["y"] = rows["year"] * 0.01 + np.sin(rows["month"]) + rng.normal(0, 0.004, len(rows))
    drivers = {}
    for w in (0.0, 0.5):
        rows[f"h{w}"], rows[f"c{w}"] = [w * np.roll(v, 1) + (1 - w) * v for v in (heat, cool)]
        drivers[w] = (f"h{w}", f"c{w}")
    rows["y"] += 0.012 * rows["h0.5"] + 0.007 * rows["c0.5"]
    fit = D.load_fit(rows, "y", drivers, lags=12)
    assert fit["billing_weight"] == 0.5
    assert (fit["heating"], fit["cooling"]) == pytest.approx((0.012, 0.007), abs=5e-4)
    assert D.load_fit(rows.head(20), "y", drivers) is None


def test_normal_leaves_itself_out_and_obeys_the_cut_off(spark):
    values = [3.0, None, 5.0, 8.0, 1.0]
    rows = spark.createDataFrame([("u", 2000 + i, v) for i, v in enumerate(values)], "unit string, y int, v double")
    got = [tuple(r) for r in rows.select("y", R.leave_one_out_normal("v", ["unit"], "y", 1), R.leave_one_out_normal("v", ["unit"], "y", 2, known=2002)).orderBy("y").collect()]
    assert got == [(2000, None, 5.0), (2001, 4.0, 4.0), (2002, 8.0, 3.0), (2003, 3.0, 5.0), (2004, 8.0, 5.0)]


def test_runs_keep_only_long_or_ongoing_ones(spark):
    x = [0, 1, 1, 0, 2, 3, 1, 0, -1, -2, -3, 0, 1]
    rows = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "k string, t int, v double")
    got = [(r["phase"], r["first"], r["last"], r["peak"], r["peak_at"], r["status"]) for r in R.runs(rows, ["k"], "t", "v", 1.0, 3).orderBy("first").collect()]
    assert got == [("warm", 4, 6, 3.0, 5, "complete"), ("cold", 8, 10, -3.0, 10, "complete"), ("warm", 12, 12, 1.0, 12, "ongoing")]


def test_itemsets_equal_enumeration(spark):
    rng = np.random.default_rng(9)
    baskets = [sorted({f"i{k}" for k in rng.integers(0, 7, 4)}) for _ in range(40)]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(baskets)], "b int, items array<string>")
    got = {tuple(r["items"]): r["n"] for r in N.itemsets(rows, "items", 4, 3).collect()}
    want = {}
    for k in (1, 2, 3):
        for c in itertools.combinations([f"i{j}" for j in range(7)], k):
            if (n := sum(set(c) <= set(b) for b in baskets)) >= 4:
                want[c] = n
    assert got == want


def test_lower_bound_is_below_dtw(spark):
    rng = np.random.default_rng(10)
    pairs = [(rng.normal(size=6).tolist(), rng.normal(size=6).tolist()) for _ in range(20)]
    got = spark.createDataFrame(pairs, "a array<double>, b array<double>").select(N.lower_bound(F.col("a"), F.col("b"), 2)).collect()
    for (a, b), r in zip(pairs, got, strict=True):
        assert r[0] <= plain_dtw(a, b, 2) + 1e-9
