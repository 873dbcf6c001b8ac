"""Rows of a query and of its SQL, in a form that can be compared."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + ('/*.parquet' if os.path.isdir(p) else '')}'")
    return con


def _plain(v):
    return float(f"{v:.11g}") if isinstance(v, float) else v


def rows_of(df) -> list:
    cols = sorted(df.columns)
    return sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(con, sql: str, columns: list[str]) -> list:
    r = con.sql(sql)
    assert sorted(r.columns) == sorted(columns)
    at = [r.columns.index(c) for c in sorted(r.columns)]
    return sorted((tuple(_plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
