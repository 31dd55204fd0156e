"""Comparison of a query's rows with those of its SQL oracle."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 12) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def ordered(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in by], sorted((tuple(plain(r[i]) for i in by) for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    """Empty if rows and columns agree."""
    mine = ordered(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    other = ordered([c[0] for c in got.description], got.fetchall())
    if mine[0] != other[0]:
        return f"columns {mine[0]} and {other[0]}"
    if len(mine[1]) != len(other[1]):
        return f"{len(mine[1])} rows and {len(other[1])}"
    for a, b in zip(mine[1], other[1], strict=True):
        if a != b:
            return f"{a} and {b}"
    return ""
