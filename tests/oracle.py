"""Side-by-side comparison of queries and their SQL, as sorted rows with columns by name."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 9)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([plain(r[i]) for i in order] for r in data), key=lambda r: [str(x) for x in r])


def compare(spark, con, sf_dir, query, sql):
    got = query(spark, sf_dir)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(list(want.columns), want.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3]
