"""Runs a query in Spark and its SQL in DuckDB and compares the rows, whatever their order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def connection(sf_dir: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x) -> str:
    if pd.isna(x):
        return "null"
    return f"{float(x):.6f}" if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)


def rows(frame, columns: list[str]) -> list[tuple]:
    return sorted(tuple(map(_cell, r)) for r in frame[columns].itertuples(index=False, name=None))


def assert_same(spark, name: str, query, sql: str, sf_dir: str = DATA) -> None:
    got, want = query(spark, sf_dir).toPandas(), connection(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns), name
    cols = sorted(got.columns)
    assert rows(got, cols) == rows(want, cols), name
