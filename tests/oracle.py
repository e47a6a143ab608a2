"""Runs registered queries beside their SQL on the given tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from marginalia.plans.bindings import RAW


def connection(folder: str):
    con = duckdb.connect()
    for name in RAW:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """(rows of the query, first differences, columns whose types differ)."""
    ours = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return len(ours), [("columns", df.columns, names)], []
    differences = [(a, b) for a, b in zip(ours, theirs) if a != b][:3]
    if len(ours) != len(theirs):
        differences.insert(0, ("rows", len(ours), len(theirs)))
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    same = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [(f.name, f.dataType.simpleString(), kinds[f.name]) for f in df.schema if same.get(f.dataType.simpleString()) != kinds[f.name]]
    return len(ours), differences, odd
