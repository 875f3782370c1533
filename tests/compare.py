"""Order-insensitive comparison of a Spark result with DuckDB on the same files."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.date().isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        return float(v)
    return v


def key(row):
    return tuple((v is not None, str(type(v).__name__), str(v)) for v in row)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    out = [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in out]
    return sorted(columns), sorted(out, key=key)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    a = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b = normal([d[0] for d in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {sorted(set(a[0]) ^ set(b[0]))}"
    if len(a[1]) != len(b[1]):
        left, right = set(a[1]), set(b[1])
        return (
            f"rows {len(a[1])} vs {len(b[1])}; only spark {list(left - right)[:2]}; "
            f"only sql {list(right - left)[:2]}"
        )
    for x, y in zip(a[1], b[1]):
        if x != y:
            diff = [(c, p, q) for c, p, q in zip(a[0], x, y) if p != q]
            return f"first difference {diff[:6]} in {x[:4]}"
    return None
