"""Compare a query with its DuckDB text on the smallest tables."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf: str = SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v + 0.0:.6g}"
    return "null" if v is None else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in values)


def same(spark, query, sql, sf: str = SF):
    df = query(spark, sf)
    cur = connect(sf).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, cur.fetchall())
    assert len(got) == len(want)
    assert got == want
