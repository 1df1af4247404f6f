"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


# Spark type -> DuckDB type
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a short description of the difference."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} != {sorted(names)}"
    types = {d[0]: str(d[1]) for d in cursor.description}
    wrong = {c: (t, types[c]) for c, t in df.dtypes if TYPES.get(t) != types[c]}
    if wrong:
        return f"{name}: types {wrong}"
    if ours == theirs:
        return None
    left, right = ours - theirs, theirs - ours
    return (
        f"{name}: rows {sum(ours.values())}/{sum(theirs.values())}, only ours {sum(left.values())} "
        f"{list(left)[:2]}, only theirs {sum(right.values())} {list(right)[:2]}"
    )
