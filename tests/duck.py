"""Comparing a query with its SQL."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows) -> tuple[list[str], list[tuple]]:
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    out = [tuple(plain(r[i]) for i in at) for r in rows]
    return names, sorted(out, key=lambda r: [(x is None, str(x)) for x in r])


def same(df, con, sql: str) -> None:
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con.execute(sql)
    want = rows_of([d[0] for d in con.description], con.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
