"""Compare a query with its SQL on the smallest test tables."""

import math
import os
from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.001"


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "none"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float):
        return f"{v:.6g}"
    return str(v)


def connect():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def compare(spark, query, sql):
    got = query(spark, FOLDER)
    done = connect().execute(sql)
    names = [c[0] for c in done.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = sorted(tuple(canon(r[names.index(c)]) for c in order) for r in done.fetchall())
    have = sorted(tuple(canon(r[c]) for c in order) for r in got.collect())
    assert have == want


def available():
    return os.path.isdir(FOLDER)
