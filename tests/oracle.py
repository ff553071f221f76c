"""Compare a query's rows with DuckDB's on the smallest data folder."""

import math
import os
from pathlib import Path

import duckdb

DATA = os.environ.get("INKLOOM_TEST_DATA", "/root/testdata/sf0.001")


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows(columns, data):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(tuple(_plain(r[i]) for i in at) for r in data)


def agrees(spark, query, sql):
    df = query(spark, DATA)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    found = con.sql(sql)
    assert mine == rows(found.columns, found.fetchall())
