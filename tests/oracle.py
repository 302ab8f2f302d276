"""Runs queries and their SQL twins on one folder of tables and compares the rows."""

from __future__ import annotations

import datetime
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr), [columns[i] for i in order]


def differences(spark, con, query, sql, sf_dir):
    """None if equal, else a text."""
    df = query(spark, sf_dir)
    mine, names = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    other, theirs = rows([d[0] for d in cur.description], cur.fetchall())
    if names != theirs:
        return f"columns {names} and {theirs}"
    if len(mine) != len(other):
        return f"{len(mine)} and {len(other)} rows"
    for a, b in zip(mine, other):
        if a != b and not all(x == y or isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6) for x, y in zip(a, b)):
            return f"{a} and {b}"
    return None
