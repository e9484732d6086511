"""A query's rows against those of its SQL, on the smallest data."""

import math
import os

import duckdb

DATA = os.environ.get("ROLLFRAME_DATA", "/root/testdata/sf0.001")


def database():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in sorted(os.listdir(DATA)):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.7g}" if isinstance(v, float) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


def same(spark, database, query, sql):
    df = query(spark, DATA)
    found = database.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())
