"""Run a query and its DuckDB SQL over the same tables and compare the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def same(df, sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = c.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    at = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    want = sorted(str([r[i] for i in at]) for r in rel.fetchall())
    got = sorted(str([r[n] for n in sorted(df.columns)]) for r in df.collect())
    assert got == want
    return len(got)
