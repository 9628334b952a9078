"""Rows of Spark and DuckDB in one comparable form."""

import math
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "asDict"):
        return plain(tuple(value.asDict().values()))
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return float(value) if type(value).__name__ == "Decimal" else value


def connect(folder):
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{file}')")
    return con


def same(df, con, sql):
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    place = [df.columns.index(c) for c in rel.columns]
    ours = sorted((tuple(plain(row[i]) for i in place) for row in df.collect()), key=repr)
    theirs = sorted((tuple(plain(v) for v in row) for row in rel.fetchall()), key=repr)
    assert ours == theirs
