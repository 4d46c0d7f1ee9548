"""Compare registered queries with their SQL on one scale of the given tables."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os


def connect(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(frame, connection, statement: str) -> str | None:
    """None if both sides agree, else a short description."""
    ours_columns, ours = _table(frame.columns, [tuple(row) for row in frame.collect()])
    result = connection.execute(statement)
    sql_columns, theirs = _table([column[0] for column in result.description], result.fetchall())
    if ours_columns != sql_columns:
        return f"columns {ours_columns} != {sql_columns}"
    if ours != theirs:
        only_ours = sorted(set(ours) - set(theirs))[:2]
        only_theirs = sorted(set(theirs) - set(ours))[:2]
        return f"{len(ours)} rows against {len(theirs)}; only here {only_ours}; only there {only_theirs}"
    return None
