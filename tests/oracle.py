"""Comparing a query with its SQL on the same tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def tables(folder):
    c = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def check(spark, folder, query, sql):
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    out = tables(folder).execute(sql)
    have = [d[0] for d in out.description]
    assert sorted(have) == names
    at = [have.index(n) for n in names]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in out.fetchall())
    assert got == want
