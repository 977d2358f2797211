"""Running a query beside its SQL and comparing the rows without regard to order."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 4) + 0.0
    if hasattr(v, "is_integer") or hasattr(v, "as_tuple"):
        return round(float(v), 4)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows(columns, data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def both(spark, queries, sql, name, folder):
    df = queries[name](spark, folder)
    mine = rows(df.columns, df.collect())
    con = connect(folder)
    got = con.execute(sql[name])
    return mine, rows([c[0] for c in got.description], got.fetchall())
