"""Runs registered queries against their SQL twins in an in-process DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(value + 0.0)
    return "null" if value is None else f"{type(value).__name__}:{value}"


def _sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, connection, sql) -> list[str]:
    """Empty when both sides have the same columns and rows, to the last digit."""
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(columns)}"]
    ours = _sorted_rows([tuple(r) for r in df.collect()], df.columns)
    theirs = _sorted_rows(result.fetchall(), columns)
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows against {len(theirs)}"]
    return [f"{a} against {b}" for a, b in zip(ours, theirs) if a != b]
