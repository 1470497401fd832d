"""Compares a query with its oracle SQL in DuckDB."""

import os

import duckdb


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(repr(r[c]) for c in names) for r in df.collect())


def expected(sql, sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    rel = con.sql(sql)
    names = list(rel.columns)
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(repr(r[i]) for i in at) for r in rel.fetchall())
