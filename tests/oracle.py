"""Compare a Spark result with DuckDB's, order aside."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb
import numpy as np

SF = "/root/testdata/sf0.001"


def connection(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(records, columns) -> list[tuple]:
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[k]) for k in at) for r in records), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(cur.fetchall(), names)
