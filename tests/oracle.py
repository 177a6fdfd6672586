"""Comparison of a query with its SQL, without regard to row order."""

from __future__ import annotations

from pathlib import Path


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return tuple(map(_plain, v)) if isinstance(v, list | tuple) else v


def same(df, con, sql: str) -> None:
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    at = [rel.columns.index(c) for c in names]
    got = sorted(repr(tuple(_plain(r[c]) for c in names)) for r in df.collect())
    want = sorted(repr(tuple(_plain(r[i]) for i in at)) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
