"""Comparison of a Spark frame with DuckDB SQL over the same tables."""

from __future__ import annotations

import math
from datetime import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    found = duckdb.connect()
    for name in TABLES.split():
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return found


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def in_order(names: list[str], rows) -> list[tuple]:
    """Rows as plain tuples, columns sorted by name."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return [tuple(plain(row[k]) for k in order) for row in rows]


def compare(frame, sql: str, con: duckdb.DuckDBPyConnection) -> int:
    """Assert equal columns and rows (in any order); the number of rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    got, expected = in_order(frame.columns, frame.collect()), in_order(names, result.fetchall())
    assert sorted(got, key=str) == sorted(expected, key=str)
    return len(got)
