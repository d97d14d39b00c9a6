"""Side-by-side comparison of a Spark result with DuckDB running an oracle."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duckdb_over(root: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.date() if value.time() == datetime.time() else value
    if isinstance(value, (decimal.Decimal, float)):
        number = float(value)
        return None if math.isnan(number) else round(number, 9)
    return value


def normalised(columns, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=repr)


def spark_result(df):
    return normalised(df.columns, df.collect())


def duckdb_result(connection, sql):
    cursor = connection.execute(sql)
    return normalised([d[0] for d in cursor.description], cursor.fetchall())
