"""Run a query's SQL in DuckDB and compare it with what Spark returns."""

from __future__ import annotations

import os

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(df: DataFrame) -> list[str]:
    names = sorted(df.columns)
    return sorted(repr(tuple(r)) for r in df.select(*names).collect())


def sql_rows(folder: str, sql: str, columns: list[str]) -> list[str]:
    found = connect(folder).execute(sql)
    names = [c[0] for c in found.description]
    order = [names.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())
