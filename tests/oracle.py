"""Runs a query's SQL on the same tables and compares all rows."""

import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


def rows_of_sql(sql, folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def same_rows(df, sql, folder):
    names, wanted = rows_of_sql(sql, folder)
    columns = sorted(df.columns)
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    got = sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    assert got == sorted(tuple(plain(r[i]) for i in place) for r in wanted)
    return len(got)
