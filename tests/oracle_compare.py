"""Run registered queries and their SQL on one folder and compare the rows."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, Decimal | int):
        return f"{float(v):.9g}" if not isinstance(v, int) else str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, dict):
        return norm(list(v.values()))
    return str(v)


def same(df, con, sql):
    """None if equal, else a message."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} and {sorted(rel.columns)}"
    mine = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    at = [rel.columns.index(c) for c in names]
    other = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    if len(mine) != len(other):
        return f"{len(mine)} and {len(other)} rows; only one side has {sorted(set(mine) ^ set(other))[:4]}"
    return next((f"{names}: {a} and {b}" for a, b in zip(mine, other, strict=True) if a != b), None)
