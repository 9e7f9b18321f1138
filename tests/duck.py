"""Compares a query's rows with those of its DuckDB equivalent."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if v is None or v != v or str(v) == "<NA>":
        return "null"
    return repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(map(tuple, frame[columns].map(_plain).values.tolist()))


def assert_same(df, con, sql: str) -> None:
    got, want = df.toPandas(), con.sql(sql).df()
    if set(want.columns) < set(got.columns):  # more columns may follow
        got = got[list(want.columns)]
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
