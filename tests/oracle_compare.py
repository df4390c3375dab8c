"""Run a registered query and its SQL over the same tables and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    # Rounded means may differ in the last decimal where the sum was taken in another order.
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value + 0.0, 5)
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def spark_rows(frame):
    return sorted(frame.columns), _sorted_rows(frame.columns, frame.collect())


def duckdb_rows(connection, sql):
    result = connection.execute(sql)
    columns = [column[0] for column in result.description]
    return sorted(columns), _sorted_rows(columns, result.fetchall())


def differences(spark_result, duckdb_result, tolerance: float = 2e-5):
    """What differs, as a list of messages; empty if the tables agree."""
    (left_columns, left), (right_columns, right) = spark_result, duckdb_result
    if left_columns != right_columns:
        return [f"columns {left_columns} != {right_columns}"]
    if len(left) != len(right):
        return [f"{len(left)} rows != {len(right)} rows"]
    found = []
    for a, b in zip(left, right):
        for name, x, y in zip(left_columns, a, b):
            numbers = isinstance(x, float) and isinstance(y, float)
            same = abs(x - y) <= tolerance if numbers else x == y
            if not same or type(x) is not type(y):
                found.append(f"{name}: {x!r} != {y!r} in {a} / {b}")
    return found
