"""Comparison of a query with its DuckDB statement on one data folder."""

import glob
import math
import os

import duckdb


def views(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v if isinstance(v, bool) else str(v)
    return f"{v:.9g}"


def compare(con, sql, df):
    names = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    at = [list(rel.columns).index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == want
