"""Row comparison of a Spark result with DuckDB's."""

import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)) or (isinstance(v, int) and abs(v) < 10**6):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows_of(names, rows, columns):
    at = [names.index(c) for c in columns]
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    other = con.sql(sql)
    assert sorted(other.columns) == columns
    assert rows_of(df.columns, df.collect(), columns) == rows_of(list(other.columns), other.fetchall(), columns)
