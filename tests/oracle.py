"""Compares a query with its SQL on DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def check(df, sql, sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    for name, kind in df.dtypes:
        assert KINDS[kind] == kinds[name], (name, kind, kinds[name])
    at = [rel.columns.index(c) for c in names]
    want = sorted(tuple(_norm(r[i]) for i in at) for r in rel.fetchall())
    got = sorted(tuple(_norm(r[c]) for c in names) for r in df.collect())
    assert got == want
