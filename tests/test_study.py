"""The study over a synthetic world: every table, the planted effects, resumption; kernels against plain versions."""

import copy
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_warehouse import raw  # noqa: F401  (a fixture)
from thermocline import config
from thermocline.operators import climate as K
from thermocline.operators import models as D
from thermocline.operators import stats as S
from thermocline.plans import build, study, views, warehouse
from thermocline.sources import replica
from thermocline.sources.text import STATE_CODES


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("study")


@pytest.fixture(scope="module")
def world(folder):
    made = replica.build(seed=8, first=1994, last=2012)
    replica.write(made, folder / "r")
    return made


@pytest.fixture
def cfg(raw, folder):  # noqa: F811
    own = copy.deepcopy(raw)
    names = {"roni": "RONI.ascii.txt", "oni": "oni.ascii.txt", "weekly": "wksst9120.for", "nino34_long": "nino34.long.anom.data", "retail": "sales_revenue.xlsx", "retail_history": "HS861M_1990-2009.xlsx"}
    own["sources"] |= {k: f"https://localhost/{v}" for k, v in names.items()} | {"climdiv_elements": ["tmpc", "pcpn", "hddc", "cddc"]}
    own["paths"]["raw"] = "r"
    own["climate"] |= {"weight_years": [2005, 2010]}
    own["teleconnect"] |= {"variables": ["tmp", "pcpn"], "surrogates": 99, "bootstrap": 100, "max_lead": 1}
    own["cluster"] |= {"variables": ["tmp"], "k_max": 4, "bootstrap": 10}
    own["rules"] |= {"permutations": 99, "min_support": 0.15, "min_confidence": 0.4, "min_lift": 1.1, "max_len": 3}
    own["forecast"] |= {"first_climate_winter": 2009, "first_sales_winter": 2010, "bootstrap": 100, "train_years": 8, "billing_weights": [0.25, 0.5], "min_ess": 4.0}
    own["outlook"] = {"winter": 2012, "scenarios": [-1.0, 1.5]}
    own["prices"] |= {"permutations": 99, "min_winters": 8, "hub_regions": {"MIDC": "NORTH", "SP15": "SOUTH"}, "hydro_hub": "MIDC", "hydro_reference": "SP15", "hydro_states": ["WA", "OR", "ID"], "hydro_precip_months": [10, 11, 12, 1, 2, 3]}
    return config.parse(own, folder)


def test_every_table_and_the_planted_effects(spark, world, cfg, folder):
    (folder / "settings.toml").write_text("x = 1\n")
    build.build(spark, cfg)
    t = build.analyze(spark, cfg, folder / "settings.toml")
    made = {n for s in study.STAGES for n in s.makes} | {"outlook_status", "run_info"}
    assert made <= set(t)
    assert {n for n in made if not t[n].limit(1).count()} <= {"rule"}

    states = list(STATE_CODES.values())
    tele = t["teleconnection"]
    assert tele.count() == 2 * 48 * 12 * 2 and t["teleconnection_summary"].agg(F.sum("tests")).first()[0] == tele.count()
    winter = {r["unit"]: r["m"] for r in tele.where("variable = 'tmp' and month in (12, 1, 2) and lead = 0").groupBy("unit").agg(F.avg("r").alias("m")).collect()}
    assert np.corrcoef([winter[s] for s in states], world.winter_tmp)[0, 1] > 0.7
    finger = t["fingerprint"].where("variable = 'tmp' and season = 'DJF'").collect()
    assert {r["in_field"] for r in finger} == {True, False} and len(finger) == 52
    warm = next(r for r in finger if r["unit"] == states[0])
    assert warm["el_nino_mean"] > 0 and warm["el_nino_lo"] <= warm["el_nino_mean"] <= warm["el_nino_hi"] and warm["la_nina_mean"] < warm["el_nino_mean"]
    score = t["cluster_score"].collect()
    assert {r["k"] for r in score} == {2, 3, 4} and sum(r["chosen"] for r in score) == 1
    sides = {r["state"]: r["cluster"] for r in t["cluster_state"].collect()}
    assert len(sides) == 48 and sides[states[0]] != sides[states[-1]]

    slope = {r["market"]: r for r in t["price_premium_summary"].collect()}
    for market, r in slope.items():
        own = [(v["hdd_pct"], v["premium"]) for v in t["price_premium"].where(F.col("market") == market).collect() if v["premium"] is not None and v["hdd_pct"] is not None]
        x, y = np.array(own).T
        b, a = np.polyfit(x, y, 1)
        assert (r["winters"], r["slope_per_hdd_pct"], r["intercept"], r["resid_sd"]) == (len(own), pytest.approx(b), pytest.approx(a), pytest.approx(np.sqrt(((y - a - b * x) ** 2).sum() / (len(own) - 2))))
        assert r["el_nino_n"] + r["la_nina_n"] + r["neutral_n"] == r["winters"] and 0 < r["p"] <= 1
    outlook = {(r["level"], r["unit"], r["method"]): r for r in t["outlook"].collect()}
    assert {k[2] for k in outlook} == set(cfg.forecast.methods) and {k[0] for k in outlook} == {"climate", "sales"} and all(r["lo"] <= r["median"] <= r["hi"] for r in outlook.values())
    fan = {r["scenario_djf"]: r["mean"] for r in t["outlook_scenario"].where(F.col("unit") == states[0]).collect()}
    assert fan[1.5] < fan[-1.0]  # a warm ocean, warm winters there
    drawn = {(r["market"], r["method"]): r for r in t["outlook_price"].collect()}
    for (market, method), r in drawn.items():
        assert r["premium_lo"] < r["premium_median"] < r["premium_hi"] and method in cfg.forecast.methods and market in slope
    assert {r["subset"] for r in t["backtest_score"].collect()} >= {"all"} and t["backtest"].where("method = 'perfect_weather'").count() > 0
    assert t["analog"].agg(F.max("rank")).first()[0] == cfg.analog.top_k
    n = t["event_family"].count()
    assert n and t["event_trajectory"].count() == 24 * n

    for shown in (
        views.outlook(t, "climate", "enso", "states"), views.scenario(t), views.price_outlook(t, "climatology"), views.analog_outlook(t), views.enso_history(t), views.analog_table(t), views.top_el_ninos(t), views.fingerprint(t, "tmp", "DJF"), views.field_counts(t), views.lead_grid(t, "tmp"),
        views.clusters(t), views.backtest_methods(t, "sales"), views.backtest_map(t, "climate", "all", "enso"), views.backtest_regions(t, "climate", "all", ["enso"]), views.gas_premium(t), views.premium_table(t), views.hydro(t, "precip"), views.quality_table(t),
    ):
        assert shown.count()
    views.rules_table(t).collect()
    json.loads(build.payload({"outlook": t["outlook"], "status": t["outlook_status"]}))

    assert t["hydro_lag"].count() == 2 * cfg.prices.hydro_max_lag
    assert t["hydro_lag"].where("driver = 'precip' and month between 3 and 6").agg(F.avg("r")).first()[0] < -0.2

    # A study that failed goes on where it stopped, and what it had saved stays.
    def broken(_, __):
        raise RuntimeError("stop")

    stages = [s if s.name != "hydro" else study.Stage("hydro", s.needs, ("later",), broken) for s in study.STAGES]
    with pytest.raises(RuntimeError):
        study.run(spark, cfg, str(folder / cfg.paths.gold), stages, resume=True)
    again = warehouse.tables(spark, str(folder / cfg.paths.gold))
    assert set(again) == set(t) and again["outlook"].inputFiles() == t["outlook"].inputFiles()
    with pytest.raises(ValueError):
        study.run(spark, cfg, str(folder / cfg.paths.gold), [study.Stage("x", ("nothing",), ("y",), broken)])


def test_baskets_drop_an_item_that_says_the_same(spark):
    percent = spark.createDataFrame([("hdd", "US", 2000 + k, float(k)) for k in range(9)] + [("hdd", "US", 2020, None), ("pcpn", "US", 2001, 5.0), ("pcpn", "US", 2002, 1.0), ("pcpn", "US", 2003, 3.0)], "variable string, unit string, winter int, pct double")
    winters = spark.createDataFrame([(2000 + k, f"w{k}", "el_nino" if k < 4 else "neutral", "very_strong_el_nino" if k < 2 else "weak_el_nino" if k < 4 else "neutral") for k in range(8)], "winter int, label string, phase string, category string")
    got = {r["winter"]: r["items"] for r in study.baskets(percent, winters, ["US"], ["US"]).collect()}
    assert set(got) == set(range(2000, 2008))  # 2008 has no winter, 2020 no value
    assert got[2000] == ["enso=el_nino", "enso=very_strong_el_nino", "mild:US"] and got[2002] == ["dry:US", "enso=el_nino", "enso=weak_el_nino", "mild:US"] and got[2007] == ["cold:US", "enso=neutral"]


def test_fingerprint_against_plain_loops(spark):
    rng = np.random.default_rng(5)
    units, years = ["A", "B", "C"], range(1980, 2011)
    value = {(u, y, m): round(float(rng.normal()), 3) for u in units for y in years for m in range(1, 13)}
    del value["B", 1995, 7]
    x = {(y, m): round(float(rng.normal()), 3) for y in years for m in range(1, 13)}
    rows = spark.createDataFrame([("tmp", u, y, m, v) for (u, y, m), v in value.items()], "variable string, unit string, year int, month int, value double")
    index = spark.createDataFrame([(y, m, v) for (y, m), v in x.items()], "year int, month int, x double")
    half = 4

    def anomaly(u, y, m):
        around = [value[u, z, m] for z in range(y - half, y + half + 1) if z != y and (u, z, m) in value]
        return value[u, y, m] - sum(around) / len(around) if (u, y, m) in value else None

    want = {}
    for k, season in enumerate(K.NAMES):
        for y in years:
            months = [(y - 1, 12), (y, 1), (y, 2)] if k == 0 else [(y, 3 * k + j) for j in range(3)]
            cells = {u: [anomaly(u, *ym) if ym[0] in years else None for ym in months] for u in units}
            if all(v is not None for own in cells.values() for v in own):
                want |= {(season, y, u): (x[y, 3 * k + 1], sum(own) / 3) for u, own in cells.items()}
    data = K.season_data(rows, index, half).cache()
    got = {(r["season"], r["year"], r["unit"]): (r["x"], r["value"]) for r in data.collect()}
    assert set(got) == set(want) and ("JJA", 1995, "A") not in got and all(got[k] == pytest.approx(v) for k, v in want.items())

    found = {(r["season"], r["unit"]): r for r in K.fingerprint(data, F.col("unit") != "C", 0.4, 1.2, 99, 300, q=0.1, seed=3).collect()}
    for (season, u), r in found.items():
        own = [(v, y) for (s, y, w), v in want.items() if (s, w) == (season, u)]
        xs, ys = np.array([v[0] for v, _ in own]), np.array([v[1] for v, _ in own])
        assert r["n"] == len(own) and r["r"] == pytest.approx(float(S.standard_ranks(xs) @ S.standard_ranks(ys) / len(xs)))
        assert r["slope"] == pytest.approx(np.polyfit(xs, ys, 1)[0]) and 0 <= r["p"] <= r["q"] <= 1
        for phase, keep in (("el_nino", xs >= 0.4), ("la_nina", xs <= -0.4), ("super", xs >= 1.2)):
            assert r[f"{phase}_n"] == keep.sum()
            if keep.sum() > 1:
                assert r[f"{phase}_mean"] == pytest.approx(ys[keep].mean()) and r[f"{phase}_lo"] <= r[f"{phase}_mean"] <= r[f"{phase}_hi"]
    for family in (("A", "B"), ("C",)):
        own = sorted((r["p"], k) for k, r in found.items() if k[1] in family)
        least = 1.0
        for rank in range(len(own), 0, -1):
            least = min(least, own[rank - 1][0] * len(own) / rank)
            assert found[own[rank - 1][1]]["q"] == pytest.approx(least)


def test_drawn_years_keep_series_together(spark):
    data = spark.createDataFrame([(v, s, y, u, 1.0, 2.0) for v in ("tmp", "hdd") for s in ("DJF", "MAM") for y in range(2000, 2010) if (v, s, y) != ("hdd", "MAM", 2003) for u in "ab"], "variable string, season string, year int, unit string, x double, value double")
    rows = K.drawn_years(data, 5, 1).collect()
    for rep in range(6):
        own = {}
        for r in rows:
            if r["rep"] == rep:
                own.setdefault((r["variable"], r["season"], r["unit"]), {})[r["year"]] = r["times"]
        if rep:
            assert len({tuple(sorted(v.items())) for v in own.values()}) == 1 and all(sum(v.values()) == 9 and 2003 not in v for v in own.values())
        else:
            assert all(set(v.values()) == {1} for v in own.values())


def test_draws_agree_with_the_closed_form(spark):
    mu, w, sigma = np.array([-2.0, 0.5, 3.0, 9.0]), np.array([1.0, 5.0, 0.0, 2.0]), 0.7
    share, other = D.alias_table(w)
    odds = np.array([(share[k] + sum(1 - share[j] for j in range(4) if other[j] == k and j != k)) / 4 for k in range(4)])
    assert odds == pytest.approx(w / w.sum())
    own = D.draws(mu, w, sigma, 77, 60_000, 5)
    assert (own[:100] != D.draws(mu, w, sigma, 78, 60_000, 5)[:100]).all() and (own == D.draws(mu, w, sigma, 77, 60_000, 5)).all()
    for q in (0.1, 0.5, 0.9):
        assert S.mixture_cdf(mu, w, sigma, float(np.quantile(own, q))) == pytest.approx(q, abs=0.01)
