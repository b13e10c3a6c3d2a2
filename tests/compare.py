"""Spark queries against their SQL, as multisets of rows."""

import glob
import os

import duckdb


def views(folder):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return c


def _plain(v):
    return f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)


def assert_same(df, c, sql):
    names = sorted(df.columns)
    got = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
    rows = c.execute(sql)
    at = [x[0] for x in rows.description]
    assert sorted(at) == names
    want = sorted(tuple(_plain(r[at.index(n)]) for n in names) for r in rows.fetchall())
    assert got == want
