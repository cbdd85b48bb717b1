"""A query's rows against its SQL's."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connection(sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _cell(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "~"
    if isinstance(x, float):
        return f"{x:.7g}"
    return str([_cell(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(_cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark, sf_dir: str, query, sql: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), connection(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
