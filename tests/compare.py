"""Runs a query and its SQL counterpart over the same tables and compares their rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=lambda r: tuple(map(str, r)))


def sql_rows(sql: str, folder: str = FOLDER) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=lambda r: tuple(map(str, r)))


def check(spark, module, name: str) -> None:
    df = module.QUERIES[name](spark, FOLDER)
    names, expected = sql_rows(module.SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == expected
