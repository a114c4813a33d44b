"""Compares registered queries with their SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return ("nan",)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, float)):
        return ("n", float(value)) if isinstance(value, float) else ("i", value)
    return ("s", str(value)) if value is not None else ("null",)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in data)


def differences(spark_df, con, sql: str, show: int = 3) -> str | None:
    """None when both sides agree, else what differs."""
    relation = con.sql(sql)
    left_cols, right_cols = sorted(spark_df.columns), sorted(relation.columns)
    if left_cols != right_cols:
        return f"columns {left_cols} against {right_cols}"
    left = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    right = rows(relation.columns, relation.fetchall())
    if left == right:
        return None
    only_left = [r for r in left if r not in set(right)][:show]
    only_right = [r for r in right if r not in set(left)][:show]
    return f"{len(left)} against {len(right)} rows on {left_cols}\n  spark: {only_left}\n  sql:   {only_right}"
