"""Rows of a query against the rows of its SQL twin, by DuckDB."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(v):
    return float(v) if isinstance(v, float) else list(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


def same(spark, query, sql):
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    df = query(spark, DATA)
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())
