"""Compare a registered query with its SQL twin in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from '{files}'")
    return con


def _value(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return [_value(y) for y in x]
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


def rows(names: list[str], data: list[tuple]) -> list[str]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([_value(r[k]) for k in order]) for r in data)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> int:
    df = query(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    con = connect(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    assert sorted(names) == sorted(df.columns), (name, sorted(names), sorted(df.columns))
    got, want = rows(df.columns, got_rows), rows(names, want_rows)
    assert len(got) == len(want), (name, len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, (name, len(bad), bad[:3])
    return len(got)
