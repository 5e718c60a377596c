"""Runs a query and its DuckDB SQL on the same tables and compares the rows."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    if v is None or v is pd.NaT:
        return None
    return str(v) if isinstance(v, pd.Timestamp) else v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def same(spark, query, sql: str, sf_dir: str) -> None:  # noqa: ANN001
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(columns).collect())
    result = duck(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[k]) for k in at)) for r in result.fetchall())
    assert got == want
