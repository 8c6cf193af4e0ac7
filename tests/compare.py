"""Rows of a query and of its SQL, made comparable."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "as_integer_ratio"):
        v = float(v)
        return v if math.isinf(v) or math.isnan(v) else round(v, 6)
    return str(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    got = con.sql(sql)
    names = sorted(got.columns)
    at = [got.columns.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
