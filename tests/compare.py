"""Rows of a query against the rows of its SQL."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def database(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def check(con, df, sql):
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*cols).collect())
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in res.fetchall())
    assert got == want
