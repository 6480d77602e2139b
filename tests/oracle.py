"""Compares a query with its SQL on a second engine: order of rows and columns aside, all values must agree."""

import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def tables(folder=SF):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(shown, value)) + "]"
    return repr(value)


def same(spark, con, query, sql, folder=SF):
    df = query(spark, folder)
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(df.columns) == sorted(names)
    keys = sorted(names)
    ours = sorted("|".join(shown(r[k]) for k in keys) for r in df.collect())
    theirs = sorted("|".join(shown(dict(zip(names, r, strict=True))[k]) for k in keys) for r in result.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
