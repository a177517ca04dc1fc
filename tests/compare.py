"""Run a registered query on both engines and compare the rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return round(value, 9) if not math.isnan(value) else "nan"
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        Counter(tuple(_cell(row[i]) for i in order) for row in rows),
    )


def compare(spark, con, sf, query, sql):
    """(equal, note, Spark row count)."""
    df = query(spark, sf)
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_columns, want = _rows([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}", sum(got.values())
    if got != want:
        extra = list((got - want).items())[:2]
        lacking = list((want - got).items())[:2]
        note = f"{sum(got.values())} rows, {sum(want.values())} wanted\n  + {extra}\n  - {lacking}"
        return False, note[:3000], sum(got.values())
    return True, "", sum(got.values())
