"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def kinds(value):
    return "number" if isinstance(value, bool) else type(value).__name__


def difference(spark, db, query, sql: str, folder: str) -> str | None:
    found = query(spark, folder)
    wanted = db.execute(sql)
    names = [d[0] for d in wanted.description]
    if sorted(found.columns) != sorted(names):
        return f"columns {sorted(found.columns)} against {sorted(names)}"
    left = rows_of(found.columns, found.collect())
    right = rows_of(names, wanted.fetchall())
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for a, b in zip(left, right):
        if a != b or [kinds(x) for x in a] != [kinds(x) for x in b]:
            return f"{str(a)[:400]} against {str(b)[:400]}"
    return None
