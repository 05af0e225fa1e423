"""Spark results against DuckDB's."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(v):
    return round(v, 6) if isinstance(v, float) else v


def differs(df, sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    r = c.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(r.columns)
    at = [r.columns.index(n) for n in names]
    got = Counter(tuple(tidy(x[n]) for n in names) for x in df.collect())
    want = Counter(tuple(tidy(x[i]) for i in at) for x in r.fetchall())
    return list((got - want).items())[:3], list((want - got).items())[:3]
