"""The sales model against plain loops."""

import itertools
import math

import numpy as np
import pytest

from thermocline.operators import energy as E
from thermocline.operators import mining as N
from thermocline.operators import relational as R
from thermocline.operators import stats as S

WEIGHTS, HALF, YEARS, TARGETS, FIRST, LAST = [0.0, 0.5], 4, 9, [2008, 2009], 1998, 2010
METHODS = dict(bandwidth=0.5, least=3.0, gate=0.6, analogs=2)
GAP = ("b", 2003, 3)  # a month that is in neither table


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    data = {}
    for u, (y, m) in itertools.product("ab", itertools.product(range(FIRST, LAST + 1), range(1, 13))):
        h, c = max(0.0, 20 * math.cos((m - 1) / 12 * 2 * math.pi) + rng.normal(0, 3)), max(0.0, -9 * math.cos((m - 1) / 12 * 2 * math.pi) + rng.normal())
        data[u, y, m] = [h, c]
    for (u, y, m), (h, c) in list(data.items()):
        before = data.get((u, y - (m == 1), 12 if m == 1 else m - 1), [h, c])
        data[u, y, m].append(1 + 0.02 * (y - FIRST) + 0.1 * math.sin(m) + 0.012 * (0.5 * h + 0.5 * before[0]) + 0.008 * (0.5 * c + 0.5 * before[1]) + rng.normal(0, 0.003))
    del data[GAP]
    sales = spark.createDataFrame([(u, y, m, 30, float(30 * math.exp(x[2]))) for (u, y, m), x in data.items()], "unit string, year int, month int, days int, sales_mwh double")
    climate = spark.createDataFrame([(u, y, m, 30, 30 * x[0], 30 * x[1]) for (u, y, m), x in data.items()], "unit string, year int, month int, days int, hdd double, cdd double")
    index = {(y, m): round(float(rng.normal()), 3) for y in range(FIRST, LAST + 1) for m in range(5, 12)}
    path = {y: [index[y, m] for m in range(5, 12)] for y in range(FIRST, LAST + 1)}
    distance = E.trajectory_distances(spark.createDataFrame([(y, m, v) for (y, m), v in index.items()], "year int, month int, x double"), TARGETS, 5, 11, 1)
    x = {y: round(float(v), 3) for y, v in zip(range(FIRST, LAST + 1), rng.normal(size=LAST - FIRST + 1), strict=True)}
    return path, distance, data, sales, climate, x, spark.createDataFrame(list(x.items()), "winter int, x double")


def normal(data, u, y, m, k, known):
    own = [data[u, z, m][k] for z in range(y - HALF, y + HALF + 1) if z != y and z <= known and (u, z, m) in data]
    return sum(own) / len(own) if own else None


def blend(f, y, m, w):
    return w * f(y - (m == 1), 12 if m == 1 else m - 1) + (1 - w) * f(y, m)


def djf(winter):
    return [(winter, 12), (winter + 1, 1), (winter + 1, 2)]


def test_sales_model_equals_plain_loops(world):
    path, distance, data, sales, climate, x, predictor = world
    rows = E.billed(E.by_target(E.daily(sales, climate), TARGETS, HALF), WEIGHTS)
    taken = {(r["unit"], r["target"], r["year"], r["month"]) for r in E.training(rows, YEARS, 9).collect()}
    assert taken == {(u, t, y, m) for u in "ab" for t in TARGETS for y in range(FIRST, t + 1) for m in range(1, 13) if t - YEARS < y and (y < t or m <= 9) and (y, m) != (FIRST, 1) and (u, y, m) not in (GAP, ("b", 2003, 4))}
    found = E.fits(E.training(rows, YEARS, 9), WEIGHTS).cache()
    fit = {(r["unit"], r["target"]): r for r in found.collect()}
    assert set(fit) == set(itertools.product("ab", TARGETS))
    cold = E.winters_of(rows, found)
    spread = {(r["unit"], r["target"]): (r["shift"], r["sigma"]) for r in E.calibration(cold, found, YEARS).collect()}
    moved = {(r["unit"], r["target"], r["winter"]): r["effect"] for r in E.effects(cold).collect()}
    got = {(r["unit"], r["target"], r["method"]): r for r in E.sales_hindcasts(sales, climate, predictor, TARGETS, WEIGHTS, HALF, YEARS, 9, **METHODS, distance=distance).collect()}
    for (u, t), f in fit.items():
        assert f["w"] == 0.5 and f["heating"] == pytest.approx(0.012, abs=1e-3)
        weather = [lambda y, m, k=k: data[u, y, m][k] for k in (0, 1)]
        usual = [lambda y, m, k=k: normal(data, u, y, m, k, t - 1) for k in (0, 1)]
        excess = lambda winter, level, source: np.mean([100 * (data[u, y, m][2] - f["level"][level] - f["season"][m - 1] - f["heating"] * blend(source[0], y, m, 0.5) - f["cooling"] * blend(source[1], y, m, 0.5)) for y, m in djf(winter)])
        errors = [excess(v, v, weather) for v in range(t - YEARS, t) if v in f["level"] and v + 1 in f["level"]]
        assert spread[u, t] == pytest.approx((np.mean(errors), np.std(errors, ddof=1)))
        effect = lambda winter: np.mean([100 * (f["heating"] * (blend(weather[0], y, m, 0.5) - blend(usual[0], y, m, 0.5)) + f["cooling"] * (blend(weather[1], y, m, 0.5) - blend(usual[1], y, m, 0.5))) for y, m in djf(winter)])
        past = [y for y in range(FIRST, t)]
        members = np.array([effect(y) for y in past])
        assert [moved[u, t, y] for y in past] == pytest.approx(members)
        seen, (shift, sigma) = excess(t, t, usual), spread[u, t]
        assert got[u, t, "climatology"]["observed"] == pytest.approx(seen)
        assert got[u, t, "climatology"]["crps"] == pytest.approx(S.mixture_crps(members + shift, np.ones(len(members)), sigma, seen))
        assert got[u, t, "perfect_weather"]["mean"] == pytest.approx(effect(t) + shift)
        px = np.array([x[y] for y in past])
        near = sorted(range(len(past)), key=lambda k: (round(N.dtw(path[past[k]], path[t], 1), 9), past[k]))[:2]
        assert got[u, t, "analog"]["mean"] == pytest.approx(members[near].mean() + shift)
        assert got[u, t, "linear"]["mean"] == pytest.approx(np.polyval(np.polyfit(px, members, 1), x[t]) + shift)
        assert got[u, t, "gated"]["mean"] == pytest.approx(got[u, t, "enso" if abs(x[t]) >= 0.6 else "climatology"]["mean"])


def test_climate_hindcast_is_in_per_cent_of_known_normals(world):
    _, distance, data, _, climate, x, predictor = world
    got = {(r["unit"], r["target"], r["method"]): r for r in E.climate_hindcasts(climate, predictor, TARGETS, HALF, **METHODS, distance=distance).collect()}
    for u, t in itertools.product("ab", TARGETS):
        usual = lambda y, m: 30 * normal(data, u, y, m, 0, t - 1)
        percent = lambda w: 100 * sum(30 * data[u, y, m][0] - usual(y, m) for y, m in djf(w)) / sum(usual(y, m) for y, m in djf(w))
        assert got[u, t, "climatology"]["observed"] == pytest.approx(percent(t))
        assert got[u, t, "climatology"]["mean"] == pytest.approx(np.mean([percent(y) for y in range(FIRST, t)]))
    assert {m for _, _, m in got} == {"climatology", "enso", "analog", "linear", "gated"}


def test_lag_over_a_missing_month_is_unknown(spark):
    rows = spark.createDataFrame([("a", 0, 2000, m, float(h), 0.0, float(h), 0.0, 1.0) for m, h in ((1, 1), (2, 2), (4, 4))], "unit string, target int, year int, month int, h double, c double, hn double, cn double, y double")
    whole = R.panel(rows, ["unit", "target"], ["h", "c", "hn", "cn", "y"])
    assert [(r.month, r.known, r.h) for r in whole.orderBy("at").collect()] == [(1, True, 1.0), (2, True, 2.0), (3, False, None), (4, True, 4.0)]
    assert {r.month: r.h for r in E.billed(whole, [1.0]).collect()} == {1: None, 2: 1.0, 3: None, 4: None}


def test_scores_by_subset_with_limits(spark):
    rng = np.random.default_rng(2)
    crps = {(m, t): float(rng.gamma(3)) for m in ("climatology", "enso") for t in range(1990, 2020)}
    x = {t: float(v) for t, v in zip(range(1990, 2020), rng.normal(size=30), strict=True)}
    rows = spark.createDataFrame([("sales", "US", t, m, v, t % 3 > 0) for (m, t), v in crps.items()], "level string, unit string, target int, method string, crps double, covered boolean")
    got = {(r.subset, r.method): r for r in E.scores(rows, spark.createDataFrame(list(x.items()), "winter int, x double"), 0.5, 1.0, 400, 3).collect()}
    subsets = {"all": lambda v: True, "el_nino_at_issue": lambda v: v >= 0.5, "strong_el_nino_at_issue": lambda v: v >= 1, "la_nina_at_issue": lambda v: v <= -0.5, "neutral_at_issue": lambda v: abs(v) < 0.5}
    for name, keep in subsets.items():
        own = [t for t in x if keep(x[t])]
        r = got[name, "enso"]
        a, c = (np.array([crps[m, t] for t in own]) for m in ("enso", "climatology"))
        assert (r.winters, r.crps, r.crpss, r.coverage) == (len(own), pytest.approx(a.mean()), pytest.approx(1 - a.mean() / c.mean()), pytest.approx(np.mean([t % 3 > 0 for t in own])))
        draws = rng.integers(0, len(own), (4000, len(own)))
        want = np.quantile(1 - a[draws].mean(1) / c[draws].mean(1), [0.05, 0.95])
        if len(own) > 8:
            assert [r.crpss_lo, r.crpss_hi] == pytest.approx(want, abs=0.15 * (want[1] - want[0]) + 0.02)
        assert got[name, "climatology"].crpss == pytest.approx(0)
