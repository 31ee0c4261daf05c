"""Compare a Spark result with the SQL oracle, rows in any order."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _cell(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 9))
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_cell(row[i]) for i in order] for row in rows), key=repr)


def compare(df, con, sql: str) -> int:
    result = con.sql(sql)
    expected_columns = list(result.columns)
    assert sorted(df.columns) == sorted(expected_columns), (df.columns, expected_columns)
    kinds = {name: TYPES.get(kind, kind) for name, kind in df.dtypes}
    expected_kinds = {name: str(kind) for name, kind in zip(expected_columns, result.types)}
    assert kinds == expected_kinds, {n: (k, expected_kinds[n]) for n, k in kinds.items() if k != expected_kinds[n]}
    got = _rows(df.columns, [tuple(row) for row in df.collect()])
    want = _rows(expected_columns, result.fetchall())
    assert len(got) == len(want), (len(got), len(want))
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert not wrong, wrong[:3]
    return len(got)
