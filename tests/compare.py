"""Spark results against the same SQL in DuckDB."""

import os
from collections import Counter
from decimal import Decimal

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def oracle():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def same(spark, con, query, sql):
    df = query(spark, FOLDER)
    columns = sorted(df.columns)
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(repr([plain(r[i]) for i in at]) for r in answer.fetchall())
    got = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want
