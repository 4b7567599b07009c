"""Registered queries against their SQL in DuckDB, value by value."""

from __future__ import annotations

import os

import duckdb
import numpy as np


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def value(v):
    if isinstance(v, (bool, np.bool_)) or v is None:
        return v
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    return int(v) if isinstance(v, (int, np.integer)) else str(v)


def rows(columns: list[str], found) -> tuple[list[str], list[str]]:
    """Column names in order, and the rows with their values in that order, sorted."""
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(repr(tuple(value(r[k]) for k in at)) for r in found)


def of_sql(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[str]]:
    got = con.execute(sql)
    return rows([c[0] for c in got.description], got.fetchall())
