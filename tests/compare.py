"""Spark result against DuckDB result: names, row count and values in any row order."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _cell(value):
    if value is None:
        return "\0null"
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    return str(value)


def difference(df, con, sql):
    """None when equal, else a short text."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    order = sorted(names)
    want_rows = sorted(tuple(_cell(r[names.index(n)]) for n in order) for r in want.fetchall())
    got_rows = sorted(tuple(_cell(r[n]) for n in order) for r in df.collect())
    if len(want_rows) != len(got_rows):
        return f"{len(got_rows)} rows instead of {len(want_rows)}"
    for got, wanted in zip(got_rows, want_rows):
        if got != wanted:
            return f"{order}: {got} instead of {wanted}"
    return None
