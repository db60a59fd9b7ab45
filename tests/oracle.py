"""Compares queries with the same in DuckDB's SQL."""

from __future__ import annotations

import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def rows_of_spark(df) -> list[str]:
    cols = sorted(df.columns)
    return sorted(repr(tuple(plain(r[x]) for x in cols)) for r in df.collect())


def rows_of_sql(c, sql: str) -> tuple[list[str], list[str]]:
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(tuple(plain(r[i]) for i in order)) for r in cur.fetchall())
