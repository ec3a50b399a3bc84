"""Runs a query and its SQL over the same small tables."""

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def result(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def oracle(sql):
    con = duckdb.connect()
    for f in Path(SF).iterdir():
        con.sql(f"create view {f.stem} as select * from '{f}'")
    found = con.sql(sql)
    cols = sorted(found.columns)
    at = [found.columns.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
