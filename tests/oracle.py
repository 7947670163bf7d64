"""Compare a query with its SQL on the same Parquet files."""

from __future__ import annotations

import math
import os

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return tuple(_plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def check(spark, sf: str, query, sql: str) -> int:
    df = query(spark, sf)
    with duckdb.connect() as con:
        for f in os.listdir(sf):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
        found = con.execute(sql)
        names, kinds = [d[0] for d in found.description], {d[0]: str(d[1]) for d in found.description}
        want = found.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds
    columns = sorted(names)
    a = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=str)
    b = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in want), key=str)
    assert a == b
    return len(a)
