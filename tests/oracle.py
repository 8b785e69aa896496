"""Compares a query's rows with its SQL."""

import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows_of(columns, rows):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5) if math.isfinite(v) else v
        return v

    order = sorted(columns)
    out = [tuple(plain(r[columns.index(c)]) for c in order) for r in rows]
    return order, sorted(out, key=repr)


def same(df, con, sql):
    found = con.execute(sql)
    expected = rows_of([x[0] for x in found.description], found.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    for a, b in zip(got[1], expected[1], strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-4, rel_tol=1e-4)), (a, b)
