import json

from thermocline.plans import build, views


def test_views_select_and_pivot(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    t = {
        "outlook": make([("climate", u, "enso", -0.001, 1.0, 2.0, 3.0, 0.5) for u in ("US", "TX", "NORTH")] + [("sales", "TX", "enso", 1.0, 1.0, 1.0, 1.0, 1.0)], "level string, unit string, method string, mean double, lo double, median double, hi double, prob_above double"),
        "quality": make([("a", "error", True, ""), ("b", "warn", False, ""), ("c", "error", False, "")], "name string, severity string, passed boolean, detail string"),
        "teleconnection": make([("hdd", 1, 0, 0.01, True), ("hdd", 2, 0, 0.04, False), ("hdd", 1, 1, 0.5, False)], "variable string, month int, lead int, p double, significant boolean"),
        "backtest_score": make([("climate", u, "all", m, s) for u, m, s in (("US", "enso", 0.12345), ("NORTH", "enso", 0.2), ("NORTH", "linear", -0.1), ("TX", "enso", 0.3))], "level string, unit string, subset string, method string, crpss double"),
        "cluster_state": make([(1, "warm", "TX"), (1, "warm", "AZ"), (2, "cold", "ME")], "cluster int, name string, state string"),
        "enso_event": make([(f"EN{k}", "el_nino", float(k), k) for k in range(20)] + [("LN1", "la_nina", -3.0, 5)], "event_id string, phase string, peak double, months int").selectExpr("*", "DATE'2000-01-01' first", "DATE'2000-05-01' last", "DATE'2000-03-01' peak_at"),
    }
    assert [r["unit"] for r in views.outlook(t, "climate", "enso", "states").collect()] == ["TX"]
    assert [str(r["mean"]) for r in views.outlook(t, "climate", "enso", "nation").collect()] == ["0.0"] and views.outlook(t, "climate", "enso", "regions").first()["unit"] == "NORTH"
    assert [r["status"] for r in views.quality_table(t).collect()] == ["PASS", "WARN", "FAIL"]
    assert tuple(views.field_counts(t).first()) == ("hdd", 3, 1, 2)
    assert [(r["lead"], r["1"]) for r in views.lead_grid(t, "hdd").collect()] == [(0, 1), (1, 0)]
    assert [tuple(r) for r in views.backtest_regions(t, "climate", "all", ["enso", "linear"]).collect()] == [("NORTH", 0.2, -0.1), ("US", 0.123, None)]
    assert [r["unit"] for r in views.backtest_map(t, "climate", "all", "enso").collect()] == ["TX"]
    assert [r["states"] for r in views.clusters(t).collect()] == ["AZ TX", "ME"]
    top = [r["event_id"] for r in views.top_el_ninos(t).collect()]
    assert len(top) == 12 and top[0] == "EN19"
    assert json.loads(build.payload({"q": views.quality_table(t)}))["q"][0]["status"] == "PASS"
