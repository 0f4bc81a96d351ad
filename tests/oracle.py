"""Holds a query against its SQL in DuckDB: columns, rows, values."""

import glob
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    return str(value)


def rows_of(rows, order):
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, sql, sf_dir):
    columns = sorted(df.columns)
    got = rows_of(df.select(*[f"`{c}`" for c in columns]).collect(), range(len(columns)))
    found = connect(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == rows_of(found.fetchall(), [names.index(c) for c in columns])
