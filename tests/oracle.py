"""Runs a query by Spark and its SQL by DuckDB over one folder, and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TESTDATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4; SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _key(row: tuple) -> list:
    return [(x is None, "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)) for x in row]


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty where both have the same columns and rows; else what differs first."""
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})").fetchall()
    names = sorted(x[0] for x in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description)
    if names != columns:
        return f"columns {columns}, not {names}"
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}"
    bad = 0
    for a, b in zip(sorted(got, key=_key), sorted(want, key=_key), strict=True):
        for x, y in zip(a, b, strict=True):
            if x != y and not (isinstance(x, float) and isinstance(y, (int, float)) and (math.isclose(x, y, abs_tol=2e-6) or math.isnan(x) and math.isnan(y))):
                return f"{a}, not {b}"
            bad += x != y or (isinstance(x, float) != isinstance(y, float))
    return f"{bad} values of {len(got)} rows are close but not equal" if bad else ""
