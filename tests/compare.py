"""Run a registered query and its SQL statement on the same tables and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return db


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(lines, key=repr)


def difference(df, db, sql: str) -> str | None:
    """None when both give the same columns, kinds of types and rows."""
    got_columns, got = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    want_columns, want = normal(names, cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
            "boolean": "BOOLEAN"}
    real = dict(db.execute(f"SELECT column_name, column_type FROM (DESCRIBE {sql})").fetchall())
    odd = {n: (t, real[n]) for n, t in spark_types.items() if same.get(t) != real[n]}
    if odd:
        return f"types {odd} {types}"
    if len(got) != len(want):
        only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows != {len(want)}: {only}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference {g} != {w}"
    return None
