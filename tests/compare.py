"""Compare a query with its SQL on the same tables, independent of row order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float) and value == 0.0:
        return repr(value)
    return value


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((value is None, str(value)) for value in row))


def spark_rows(frame) -> tuple[list[str], list[tuple]]:
    return sorted(frame.columns), canonical(frame.columns, [tuple(r) for r in frame.collect()])


def sql_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted(columns), canonical(columns, result.fetchall())


def differences(left: list[tuple], right: list[tuple], limit: int = 3) -> list:
    return [(a, b) for a, b in zip(left, right) if a != b][:limit]
