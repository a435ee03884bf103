"""Run a query and its DuckDB SQL over the same tables and compare the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql, sf_dir, **frames):
    c = duckdb.connect()
    for t in TABLES:
        if t not in frames and sf_dir:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for t, f in frames.items():
        c.register(t, f)
    rel = c.sql(sql)
    return rel.columns, rel.fetchall()


def key(row):
    return tuple((x is None, str(round(x, 6)) if isinstance(x, float) and math.isfinite(x) else str(x)) for x in row)


def same(df, sql, sf_dir=None, **frames):
    names, want = duck(sql, sf_dir, **frames)
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(df.columns) == sorted(names)
    got = sorted(key(tuple(r[names[i]] for i in order)) for r in df.collect())
    assert got == sorted(key(tuple(r[i] for i in order)) for r in want)
    return len(got)
