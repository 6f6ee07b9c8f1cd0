"""Runs a query and its SQL on one scale and compares the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(value(r[i]) for i in order) for r in data)


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{p}/*.parquet'" if p.is_dir() else f"create view {t} as select * from '{p}'")
    got = con.execute(sql)
    return rows([c[0] for c in got.description], got.fetchall())


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
