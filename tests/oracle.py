"""Comparison of a query with its SQL on DuckDB: columns by name, rows as a multiset."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(_plain(r[k]) for k in order) for r in rows)


def same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    expected = con.execute(sql)
    names = [c[0] for c in expected.description]
    theirs = _rows(names, expected.fetchall())
    assert sorted(df.columns) == sorted(names)
    ours = _rows(df.columns, df.collect())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
