"""Shared by tests: scales of the test tables, comparison of a query with its SQL."""

from __future__ import annotations

import glob
import os

import duckdb

DATA = os.environ.get("RELATA_TEST_DATA", "/root/testdata")
SMALL, MIDDLE = f"{DATA}/sf0.001", f"{DATA}/sf0.01"


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


def rows_of(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=lambda r: [(x is None, str(x)) for x in r])


def rows_of_sql(sql: str, folder: str = SMALL) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    return sorted(rel.columns), sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=lambda r: [(x is None, str(x)) for x in r])
