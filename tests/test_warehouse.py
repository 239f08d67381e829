import copy
import datetime as dt
import tomllib

import pytest

from thermocline import config
from thermocline.plans import warehouse

BASE = """
regions = {NORTH = NORTHSTATES, SOUTH = ["TX", "FL", "DC"]}
[paths]
raw = "r"
silver = "s"
gold = "g"
[download]
timeout_s = 60
retries = 4
backoff_s = 2.0
workers = 4
user_agent = "x"
[sources]
roni = "https://a/b"
oni = "https://a/b"
weekly = "https://a/b"
nino34_long = "https://a/b"
climdiv_base = "https://a/b/"
climdiv_elements = ["tmpc"]
retail = "https://a/b"
retail_history = "https://a/b"
wholesale_index = "http://localhost/"
wholesale_pattern = "ice"
henry_hub = "https://a/b"
[enso]
threshold = 0.5
min_months = 5
strength_edges = [0.5, 1.0, 1.5, 2.0]
base_window_years = 30
base_step_years = 5
base_anchor_year = 1956
predictor_month = 8
[climate]
first_year = 1895
anomaly_half_window = 15
weight_years = [2015, 2024]
dc_climate_state = "MD"
[teleconnect]
variables = ["tmp"]
max_lead = 6
surrogates = 999
fdr_method = "bh"
fdr_q = 0.1
bootstrap = 1000
seed = 7
[cluster]
variables = ["tmp"]
k_min = 2
k_max = 8
bootstrap = 200
seed = 11
[analog]
start_month = 1
band = 2
top_k = 8
family_k_max = 6
[rules]
min_support = 0.02
max_len = 4
min_confidence = 0.5
min_lift = 1.5
precip_regions = ["US"]
permutations = 999
fdr_q = 0.1
seed = 13
[forecast]
methods = ["climatology", "enso"]
bandwidth = 0.4
min_ess = 10.0
gate = 1.0
first_climate_winter = 1950
first_sales_winter = 1995
sector = "residential"
train_years = 15
data_through_month = 7
billing_weights = [0.0, 0.5]
hac_lags = 12
interval = 0.8
bootstrap = 2000
seed = 17
[outlook]
winter = 2026
scenarios = [1.0]
[prices]
min_days = 8
gas_min_days = 3
min_winters = 10
fall_months = [9, 10]
winter_months = [12, 1, 2]
hydro_hub = "MIDC"
hydro_reference = "SP15"
hydro_states = ["WA"]
hydro_precip_months = [10, 11]
hydro_max_lag = 9
permutations = 4999
seed = 19
hub_regions = {MIDC = "NORTH", SP15 = "SOUTH"}
"""


@pytest.fixture
def raw():
    north = [s for s in config.STATE_CODES.values() if s not in ("TX", "FL")]
    return tomllib.loads(BASE.replace("NORTHSTATES", str(north).replace("'", '"')))


def test_good_settings(raw, tmp_path):
    cfg = config.parse(raw, tmp_path)
    assert cfg.download.timeout_s == 60.0 and cfg.path("gold") == tmp_path / "g" and cfg.prices.hub_regions["MIDC"] == "NORTH"


@pytest.mark.parametrize(
    "key, value",
    [
        ("download.retries", True), ("download.workers", 0), ("sources.roni", "ftp://x"), ("sources.climdiv_base", "https://a/b"), ("sources.climdiv_elements", ["x"]), ("enso.strength_edges", [0.5, 0.4, 1, 2]), ("enso.threshold", 3.5),
        ("climate.dc_climate_state", "ZZ"), ("climate.weight_years", [2024, 2015]), ("teleconnect.fdr_method", "no"), ("cluster.k_min", 9), ("analog.start_month", 8), ("rules.precip_regions", ["WEST"]), ("rules.min_lift", 0.5),
        ("forecast.methods", ["enso"]), ("forecast.billing_weights", [1.0]), ("forecast.first_climate_winter", 1900), ("outlook.winter", 1990), ("prices.fall_months", [9, 9]), ("prices.hydro_hub", "NP15"), ("prices.hub_regions", {"X": "NORTH"}),
        ("regions.SOUTH", ["TX"]), ("paths.raw", "s"), ("paths.more", "x"), ("forecast.seed", None),
    ],
)
def test_bad_settings(raw, tmp_path, key, value):
    bad = copy.deepcopy(raw)
    section, name = key.split(".")
    if value is None:
        del bad[section][name]
    else:
        bad[section][name] = value
    with pytest.raises(config.ConfigError):
        config.parse(bad, tmp_path)


def test_missing_and_broken_files(tmp_path):
    for body in (None, "x = ["):
        if body:
            (tmp_path / "c.toml").write_text(body)
        with pytest.raises(config.ConfigError):
            config.load(tmp_path / "c.toml")


def test_gold_tables(spark, raw, tmp_path):
    cfg = config.parse(raw, tmp_path)
    retail = spark.createDataFrame([("TX", 2020, 1, "residential", 30.0, 300.0, 1.0), ("FL", 2020, 1, "residential", None, 100.0, 1.0), ("WA", 2020, 1, "residential", None, None, None)], "state string, year int, month int, sector string, revenue_k double, sales_mwh double, customers double")
    state = warehouse.states(spark, cfg, retail)
    weight = {r["state"]: r["weight"] for r in state.collect()}
    assert len(weight) == 49 and (weight["TX"], weight["FL"], weight["WA"]) == (0.75, 0.25, 0.0)
    member = warehouse.unit_members(state)
    assert member.count() == 147
    sales = {r["unit"]: r for r in warehouse.unit_sales(retail, member).collect()}
    assert (sales["SOUTH"]["sales_mwh"], sales["SOUTH"]["revenue_k"], sales["SOUTH"]["price_cents"], sales["WA"]["sales_mwh"]) == (400.0, 30.0, 7.5, None)
    assert (sales["US"]["date"], sales["US"]["days"]) == (dt.date(2020, 1, 1), 31)
    climate = spark.createDataFrame([("TX", 2020, 1, 10.0, 1.0, 0.0, 2.0), ("FL", 2020, 1, 20.0, None, 0.0, 2.0), ("MD", 2020, 1, 5.0, 1.0, 0.0, 2.0)], "state string, year int, month int, tmp double, hdd double, cdd double, pcpn double")
    units = {r["unit"]: r for r in warehouse.unit_climate(climate, state, member).collect()}
    assert (units["SOUTH"]["tmp"], units["SOUTH"]["hdd"], units["FL"]["tmp"], units["DC"]["tmp"]) == (12.5, 0.75, 20.0, 5.0)
    gas = warehouse.gas_month(spark.createDataFrame([(dt.date(2020, 1, 2), 2.0), (dt.date(2020, 1, 3), 4.0)], "date date, henry_hub double"))
    price = warehouse.price_month(spark.createDataFrame([("MIDC", dt.date(2020, 1, d), 30.0) for d in (2, 3)] + [("SP15", dt.date(2020, 1, 2), 9.0)], "hub string, date date, price double"), gas, 2).collect()
    assert [(r["hub"], r["henry_hub"], r["heat_rate"]) for r in price] == [("MIDC", 3.0, 10.0)]
    warehouse.save({"gas_month": gas}, str(tmp_path / "gold"))
    warehouse.save({"gas_month": gas}, str(tmp_path / "gold"))
    assert warehouse.read(spark, str(tmp_path / "gold"), "select * from gas_month where month = :m", m=1).count() == 1


def test_spliced_index_recovers_the_planted_relation(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    months = [(dt.date(y, m, 1), float(v)) for (y, m), v in zip([(y, m) for y in range(1900, 2021) for m in range(1, 13)], np.convolve(rng.normal(size=1500), np.ones(20) / 5, "same"), strict=False)]
    long = spark.createDataFrame(months, "date date, nino34 double")
    smooth = warehouse.sliding_anomaly(long, "nino34", 30, 5, 1956).toPandas().sort_values("date").set_index("date")["anomaly"].rolling(3, center=True).mean().dropna()
    direct = spark.createDataFrame([(d, 0.9 * float(v)) for d, v in smooth.items() if d.year >= 1950], "date date, roni double")
    index, fit = warehouse.harmonised(direct, long)
    got = fit.first()
    assert (got["slope"], got["r"], got["rmse"]) == pytest.approx((0.9, 1.0, 0.0), abs=1e-9) and index.where("source = 'calibrated'").count() == 12 * 50 - 1
