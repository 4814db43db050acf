"""Runs registered queries and their expected SQL over the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str, without: tuple[int, ...] = ()) -> duckdb.DuckDBPyConnection:
    """The tables as views; ``without`` leaves out the rows whose first column is one of these numbers."""
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        key = con.execute(f"DESCRIBE SELECT * FROM '{file}'").fetchall()[0][0]
        test = "".join(f" {'AND' if i else 'WHERE'} {key} IS DISTINCT FROM {k}" for i, k in enumerate(without))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'{test}")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple]:
    ordered = frame[sorted(frame.columns)].astype(object)
    ordered = ordered.where(ordered.notna(), None)
    return sorted(ordered.itertuples(index=False, name=None), key=repr)


def _difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = _rows(got), _rows(want)
    if a == b:
        return None
    in_a, in_b = set(a), set(b)
    only_got = [r for r in a if r not in in_b][:3]
    only_want = [r for r in b if r not in in_a][:3]
    return f"{len(a)} rows, expected {len(b)}; only got {only_got}; only expected {only_want}"


def differences(spark, sf_dir: str, query, sql: str) -> str | None:
    """What differs between a query and its SQL; None if nothing does."""
    return both_differences(spark, sf_dir, query, sql)[0]


def both_differences(spark, sf_dir: str, query, sql: str) -> tuple[str | None, str | None]:
    """The same, and what differs from the SQL over tables that lack two rows each: a comparison that cannot fail is none."""
    got = query(spark, sf_dir).toPandas()
    return tuple(_difference(got, connect(sf_dir, without).execute(sql).df()) for without in ((), (7, 9)))
