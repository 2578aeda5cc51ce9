"""Compares a DataFrame with what DuckDB gives for SQL over the same tables, without regard to order."""

import math

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else float(f"{value:.10g}")
    return str(value) if value is not None else None


def rows(found, columns, names):
    at = [columns.index(n) for n in names]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=repr)


def same(frame, con, sql):
    answer = con.sql(sql)
    assert sorted(frame.columns) == sorted(answer.columns)
    kinds = dict(zip(answer.columns, map(str, answer.types), strict=True))
    assert {c: TYPES.get(k, k) for c, k in frame.dtypes} == kinds
    names = sorted(frame.columns)
    assert rows(frame.collect(), frame.columns, names) == rows(answer.fetchall(), answer.columns, names)
