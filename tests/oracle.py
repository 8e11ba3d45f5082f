"""Compare queries with their SQL in DuckDB: columns, rows, values."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, bool):
        return x
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def compare(df, con, sql):
    """None if equal, else what differs."""
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    order = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [rel.columns.index(c) for c in order]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if not got:
        return "no rows"
    if got != want:
        return f"{sum(got.values())} rows, {sum(want.values())} wanted; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
    return None
