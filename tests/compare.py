"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{d}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else v
    return v


def differences(con, sql: str, frame) -> list[str]:
    """What differs, in words; empty if nothing does."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} against {sorted(names)}"]
    order = sorted(names)
    a = Counter(tuple(plain(row[c]) for c in order) for row in frame.collect())
    b = Counter(tuple(plain(row[names.index(c)]) for c in order) for row in want)
    if a == b:
        return []
    return [f"{sum(a.values())} rows against {sum(b.values())}; {sum((a - b).values())} differ", f"spark {sorted(map(str, (a - b)))[:2]}", f"duckdb {sorted(map(str, (b - a)))[:2]}"]
