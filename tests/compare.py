"""Run queries next to their DuckDB SQL and compare all values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if hasattr(value, "to_integral_value"):
        return float(value)
    return value


def difference(spark, connection, query, sql: str, sf_dir: str) -> str:
    """Empty text when both sides agree."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cursor = connection.execute(sql)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    place = [df.columns.index(c) for c in sorted(names)]
    other = [names.index(c) for c in sorted(names)]
    ours = Counter(tuple(_plain(r[i]) for i in place) for r in got)
    theirs = Counter(tuple(_plain(r[i]) for i in other) for r in want)
    if ours == theirs:
        return ""
    a, b = list((ours - theirs).elements()), list((theirs - ours).elements())
    key = lambda row: tuple(str(v) for v in row)
    return f"{len(got)} rows against {len(want)}; {sorted(names)} only ours {sorted(a, key=key)[:2]} only theirs {sorted(b, key=key)[:2]}"
