"""The build over a synthetic world, from raw files to checked gold tables and hindcasts."""

import copy

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_warehouse import raw  # noqa: F401  (a fixture)
from thermocline import config
from thermocline.operators import quality as Q
from thermocline.plans import build, checks, warehouse
from thermocline.sources import replica


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("world")


@pytest.fixture(scope="module")
def world(folder):
    made = replica.build(seed=4, first=2000, last=2012)
    replica.write(made, folder / "r")
    return made


@pytest.fixture
def cfg(raw, folder):  # noqa: F811
    own = copy.deepcopy(raw)
    names = {"roni": "RONI.ascii.txt", "oni": "oni.ascii.txt", "weekly": "wksst9120.for", "nino34_long": "nino34.long.anom.data", "retail": "sales_revenue.xlsx", "retail_history": "HS861M_1990-2009.xlsx"}
    own["sources"] |= {k: f"https://localhost/{v}" for k, v in names.items()} | {"climdiv_elements": ["tmpc", "pcpn", "hddc", "cddc"]}
    own["paths"]["raw"] = "r"
    own["climate"] |= {"weight_years": [2005, 2010]}
    return config.parse(own, folder)


def test_build_checks_and_hindcasts(spark, world, cfg, folder, raw):  # noqa: F811
    found = {r["name"]: r["passed"] for r in build.build(spark, cfg).collect()}
    assert len(found) == 20 and all(found.values()), found
    t = warehouse.tables(spark, str(folder / raw["paths"]["gold"]))
    assert set(t) == {"enso_season", "enso_week", "nino34_month", "climate_month", "retail_month", "price_day", "gas_day", "enso_month", "enso_calibration", "state", "unit_member", "unit_climate", "unit_sales", "gas_month", "price_month", "source_file", "quality"}
    assert t["price_day"].count() == len(world.wholesale) and t["retail_month"].count() == 3 * len(world.retail)
    assert t["unit_climate"].where("unit = 'US'").count() == 156
    events, cold = build.winters(t["enso_month"], cfg)
    index = np.array([r["index"] for r in t["enso_month"].orderBy("date").collect()])
    assert events.where("phase = 'el_nino'").count() > 0 and index.max() == pytest.approx(events.agg(F.max("peak")).first()[0])
    assert cold.where("category = 'neutral' or event_id <> ''").count() == cold.count()


def test_checks_see_what_is_wrong(spark, world, cfg, folder, raw):  # noqa: F811
    t = warehouse.tables(spark, str(folder / raw["paths"]["gold"]))
    bad = t | {
        "retail_month": t["retail_month"].withColumn("sales_mwh", F.when(F.col("state") == "TX", -1.0).otherwise(F.col("sales_mwh"))),
        "gas_day": t["gas_day"].withColumn("henry_hub", F.lit(99.0)),
        "climate_month": t["climate_month"].where("not (state = 'TX' and year = 2001 and month = 5)"),
        "state": t["state"].withColumn("weight", F.col("weight") * 2),
        "enso_season": t["enso_season"].where("not (year = 2003 and month = 4)"),
    }
    failed = {r["name"] for r in checks.all_checks(bad, cfg).where("not passed").collect()}
    assert {"retail_positive_sales", "retail_price_consistent", "henry_hub_range", "climate_complete_years", "weights_sum_to_one", "roni_continuous"} <= failed
    with pytest.raises(Q.QualityError):
        Q.enforce(checks.all_checks(bad, cfg))
