"""Comparing a query with its oracle."""

import math
import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.execute(sql).df()


def rows(df):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, pd.Timestamp):
            return str(v)
        if type(v).__name__.startswith("float"):
            return str(int(v)) if v == int(v) else repr(float(v))
        return str(v)

    names = sorted(df.columns)
    return names, sorted(tuple(text(v) for v in r) for r in df[names].itertuples(index=False, name=None))
