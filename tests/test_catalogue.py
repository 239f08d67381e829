import pytest

import __spark_entry__ as entry
from tests.oracle import same_rows
from thermocline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf, name):
    same_rows(catalogue.QUERIES[name](spark, sf), sf, catalogue.ORACLES[name])


#: What holds for every row of the queries that SQL cannot express; their kernels are tested by themselves.
HOLDS = {
    "predictive_mixture": "lo <= median and median <= hi and prob_above between 0 and 1 and pit between 0 and 1 and crps >= 0 and covered = (lo <= hi and pit between 0.1 - 1e-6 and 0.9 + 1e-6)",
    "load_model": "billing_weight in (0.0, 0.25, 0.5, 0.75) and r2 between 0 and 1 and heating_se >= 0 and cooling_se >= 0 and months >= 36",
    "teleconnection": "abs(r) <= 1 + 1e-9 and p between 0 and 1 and q >= p - 1e-12 and q <= 1 and significant = (q <= 0.1) and lead between 0 and 2",
    "ward_clusters": "cluster between 1 and k and silhouette between -1 and 1 and k between 2 and 5",
    "cluster_scores": "silhouette between -1 and 1 and stability between -1 and 1 and stability_p10 <= 1 and k between 2 and 5",
    "event_families": "silhouette between -1 and 1 and family between 'A' and 'D'",
    "nearest_family": "distance >= 0 and family between 'A' and 'D'",
    "outlook_price": "lo <= median and median <= hi and prob_negative between 0 and 1",
    "sales_fits": "months >= 36 and r2 between 0 and 1 and billing_weight in (0.0, 0.25, 0.5, 0.75)",
    "sales_hindcasts": "lo <= median and median <= hi and crps >= 0 and pit between 0 and 1 and covered = (observed between lo and hi)",
    "climate_hindcasts": "lo <= median and median <= hi and crps >= 0 and pit between 0 and 1 and covered = (observed between lo and hi)",
    "hindcast_scores": "crps >= 0 and coverage between 0 and 1 and (method <> 'climatology' or abs(crpss) < 1e-12) and winters > 0 and (crpss_lo is null or crpss_lo <= crpss_hi)",
    "fingerprint": "abs(r) <= 1 + 1e-9 and p between 0 and 1 and q >= p - 1e-12 and q <= 1 and (el_nino_n < 2 or el_nino_lo <= el_nino_hi) and (la_nina_n < 2 or la_nina_lo <= la_nina_hi)",
    "outlook_draws": "lo <= median and median <= hi and prob_negative between 0 and 1",
}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_holds(spark, name):
    rows = catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").selectExpr("*", f"{HOLDS[name]} as holds").collect()
    assert rows and [r for r in rows if not r["holds"]] == []


def test_flagship_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
