"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf_dir) / t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v


def bag(columns: list[str], rows: list[tuple]) -> Counter:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in at) for r in rows)


def mismatch(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = bag(df.columns, got), bag(names, want)
    if a == b:
        return None if a else "both empty"
    only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
    return f"rows {len(got)} / {len(want)}; spark only {only_a}; sql only {only_b}"
