"""Comparison of a Spark result with DuckDB on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else v + 0.0
        return v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def same(df, con, sql):
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    want = canonical(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    assert [g for g, w in zip(got, want, strict=True) if g != w][:3] == []
