"""Comparison of a query with its SQL in DuckDB on the same tables."""

import decimal
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(cols, got):
    at = [cols.index(c) for c in sorted(cols)]
    return Counter(repr(tuple(plain(r[i]) for i in at)) for r in got)


def differences(df, con, sql):
    """Rows of the query only, rows of the SQL only."""
    answer = con.execute(sql)
    cols = [c[0] for c in answer.description]
    assert sorted(cols) == sorted(df.columns)
    ours, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(cols, answer.fetchall())
    return list((ours - theirs).elements())[:5], list((theirs - ours).elements())[:5]
