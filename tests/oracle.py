"""Compare a registered query with its SQL on the same Parquet files."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb


def _cell(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def run_sql(sql, folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    rel = con.sql(sql)
    return rel.columns, [str(t) for t in rel.types], rel.fetchall()


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def difference(df, sql, folder):
    """None when equal, else a short description."""
    names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cols, types, rows = run_sql(sql, folder)
    want_names, want = _rows(cols, rows)
    if names != want_names:
        return f"columns {names} != {want_names}"
    spark_types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    odd = {c: (spark_types[c], t) for c, t in zip(cols, types) if spark_types[c] != t}
    if odd:
        return f"types {odd}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{dict(zip(names, a))} != {dict(zip(names, b))}"
    return None
