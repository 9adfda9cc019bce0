"""Compares a query with its SQL on DuckDB, row by row in any order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    return f"{v + 0.0:.8g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted("|".join(map(text, r)) for r in df[names].itertuples(index=False))


def same(spark, sf, query, sql):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = rows(query(spark, sf).toPandas()), rows(db.execute(sql).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert [p for p in zip(got[1], want[1]) if p[0] != p[1]][:3] == []
    return len(want[1])
