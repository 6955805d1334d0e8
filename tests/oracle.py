"""Holds queries against their DuckDB SQL: same columns, same rows (doubles to 9 significant digits)."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, int):
        return v
    return str(v)


def key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def differences(spark_df, sql: str, sf_dir: str) -> str:
    """Empty if they agree."""
    names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    want_names, want = oracle_rows(sql, sf_dir)
    if names != want_names:
        return f"columns {names} and {want_names}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows, e.g. {got[:1]} and {want[:1]}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[:2]}" if bad else ""
