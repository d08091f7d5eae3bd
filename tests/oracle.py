"""Runs a query on Spark and its SQL on DuckDB and compares rows, order aside."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime | datetime.date):
        return str(v)
    if isinstance(v, list | tuple):
        return str([_plain(x) for x in v])
    return "<null>" if v is None else str(v)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """An empty string if both give the same rows."""
    df = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(range(len(names)), key=lambda i: names[i])
    theirs = sorted(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())
    cols = sorted(df.columns)
    ours = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    if ours == theirs:
        return ""
    return f"{len(ours)} rows and {len(theirs)}; only here {[x for x in ours if x not in set(theirs)][:3]}, only there {[x for x in theirs if x not in set(ours)][:3]}"
