"""Run a registered query and its SQL on the same tables and compare them by value."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return repr(value)


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    got = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())
    assert len(got) == len(want)
    different = [(a, b) for a, b in zip(got, want) if a != b]
    assert not different, f"{len(different)} rows differ, first: {different[0]}"
