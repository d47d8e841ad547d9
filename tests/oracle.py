"""Compare a registered query with its DuckDB statement: columns, row counts and values in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x) if x % 1 else int(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    found = connect(sf_dir).execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(names)
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(names, found.fetchall())
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    odd = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not odd, odd[:3]
