"""Compares a query with its SQL on the same tables: names, row count and sorted values."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=key), [names[i] for i in order]


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want, wanted = rows_of(rel.columns, rel.fetchall())
    assert names == wanted, (names, wanted)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want):
        assert a == b, (names, a, b)
