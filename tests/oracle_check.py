"""Compares a query with its SQL: column names, row count, sorted values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def kinds(types):
    names = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
             "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
    return [names.get(t, t) for t in types]


def compare(frame, con, sql):
    """None when equal, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = [str(d[1]) for d in result.description]
    rows = result.fetchall()
    ours = [tuple(r) for r in frame.collect()]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if len(rows) != len(ours):
        return f"rows {len(ours)} != {len(rows)}"
    theirs = dict(zip(names, types))
    for name, kind in zip(frame.columns, kinds(t for _, t in frame.dtypes)):
        if theirs[name] != kind:
            return f"type of {name}: {kind} != {theirs[name]}"
    a, b = normal(frame.columns, ours), normal(names, rows)
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"
    return None
