"""Comparison of a query with its SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd


def connect(base: str):
    c = duckdb.connect()
    for f in os.listdir(base):
        p = f"{base}/{f}"
        c.execute(f"create view {f.split('.')[0]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    if v is None or pd.isna(v):
        return "~"
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(float(v), 6))
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark, con, query, sql: str, base: str) -> None:
    got, want = query(spark, base).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
