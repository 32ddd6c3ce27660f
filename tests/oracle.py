"""Compare a query's rows with its DuckDB SQL."""

import math
from collections import Counter

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return str(v) if v is not None and not isinstance(v, (bool, int, str)) else v


def compare(spark, sf, query, sql):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    order = sorted(names)
    a = Counter(tuple(_plain(r[n]) for n in order) for r in df.collect())
    b = Counter(tuple(_plain(dict(zip(names, r))[n]) for n in order) for r in want)
    assert a == b, (len(want), list((a - b).items())[:3], list((b - a).items())[:3])
