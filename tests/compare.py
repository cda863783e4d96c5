"""Run a registered query and its SQL on the same tables and compare all rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def _value(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def bag(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    """(rows, differing rows, sample of differences); values must be exactly equal."""
    df = query(spark, sf_dir)
    got = bag(df.collect(), df.columns)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = bag(cursor.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns), (sorted(df.columns), sorted(columns))
    only_got, only_want = got - want, want - got
    sample = (list(only_got.items())[:2], list(only_want.items())[:2])
    return sum(got.values()), sum(only_got.values()) + sum(only_want.values()), sample
