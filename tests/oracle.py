"""Rows of a query against the rows of its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return round(float(x), 6) + 0.0
    if isinstance(x, (dt.datetime, dt.date)):
        return str(x)[:19]
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def compare(spark, name: str, f, sql: str, sf_dir: str) -> str | None:
    df = f(spark, sf_dir)
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} against {sorted(names)}"
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, cur.fetchall())
    if got != want:
        only = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{name}: {len(got)} rows against {len(want)}; {only}"
    return None if got else f"{name}: no rows"
