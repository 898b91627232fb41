"""Holds a Spark result against DuckDB's, without regard to the order of rows."""

from __future__ import annotations

import math
import os

import duckdb

from lakewright.session import TABLES


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v + 0.0:.10g}")
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    return v


def rows(names, data) -> list:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def differs(df, con, sql: str) -> str:
    """What differs, or an empty text."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, rel.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a} and {b}"
    return ""
