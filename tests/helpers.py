"""Comparison of a query with its SQL in DuckDB, whatever the order of rows and columns."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return str(x)


def duck(sql, sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = c.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def same(df, sql, sf):
    """True, or an AssertionError that shows rows of one side."""
    names, rows = duck(sql, sf)
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    order = [names.index(c) for c in df.columns]
    mine, theirs = Counter(tuple(map(value, r)) for r in df.collect()), Counter(tuple(value(r[i]) for i in order) for r in rows)
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
    return True
