"""Compare a Spark result with the DuckDB result of the matching SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, repr(float(v) + 0.0))
    if isinstance(v, (list, tuple)):
        return (1, repr([_cell(x) for x in v]))
    return (1, str(v))


def normal(columns, rows):
    """Columns by name, rows in a fixed order, cells as text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KIND = {
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "hugeint": "huge",
    "integer": "int", "double": "float", "float": "float", "string": "text", "varchar": "text",
    "boolean": "bool", "timestamp_ntz": "time", "timestamp": "time", "date": "date",
}


def kind(t: str) -> str:
    return KIND.get(t.lower(), t.lower())


def compare(spark_df, con, sql: str) -> str | None:
    """None if both agree, else what differs."""
    found = con.sql(sql)
    names, types = found.columns, [str(t) for t in found.types]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    ours = {c: kind(t) for c, t in spark_df.dtypes}
    theirs = {c: kind(t) for c, t in zip(names, types)}
    types_note = {c: (ours[c], theirs[c]) for c in ours if ours[c] != theirs[c]}
    if types_note:
        return f"types {types_note}"
    a = normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    b = normal(names, found.fetchall())
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}"
    return None
