"""Compares a DataFrame with DuckDB's answer, rows in any order."""

from __future__ import annotations

import os

import duckdb
import numpy as np


def value(v):
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(value(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, value(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return value(v.asDict())
    return v


def key(row):
    return tuple((v is None, str(v)) for v in row)


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    got = con.sql(sql)
    cols = sorted(got.columns)
    return cols, sorted((tuple(value(r[got.columns.index(c)]) for c in cols) for r in got.fetchall()), key=key)


def same(df, sql: str, sf_dir: str) -> None:
    cols, want = sql_rows(sql, sf_dir)
    assert sorted(df.columns) == cols
    got = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=key)
    assert len(got) == len(want)
    assert got == want
