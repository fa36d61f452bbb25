"""Comparison of a Spark query with its SQL in DuckDB, as multisets of rows with columns by name."""

import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return v


def compare(spark, query, sql, folder):
    df = query(spark, folder)
    names = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    out = con.sql(sql)
    assert sorted(out.columns) == names
    at = [out.columns.index(c) for c in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in out.fetchall())
    assert ours == theirs
