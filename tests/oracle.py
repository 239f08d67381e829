"""Compares a query with its DuckDB SQL on the same files."""

import glob
import os

import duckdb


def same_rows(frame, folder: str, sql: str) -> None:
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(sql).df()
    got = frame.toPandas()
    names = sorted(want.columns)
    assert sorted(got.columns) == names

    def plain(x):
        if x is None or (isinstance(x, float) and x != x) or str(x) in ("NaT", "<NA>"):
            return None
        if hasattr(x, "isoformat"):
            return x.isoformat()[:10]
        return list(x) if hasattr(x, "__len__") and not isinstance(x, str) else x

    rows = lambda f: sorted(map(repr, ([_number(plain(x)) for x in r] for r in f[names].astype(object).to_numpy())))
    assert rows(got) == rows(want)


def _number(x):
    return float(x) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__module__ == "numpy" and not isinstance(x, str) else x
