"""Spark rows against DuckDB rows, by value and without order."""

import os

import duckdb
import numpy as np
import pandas as pd


def connection(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    return con


def value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, np.ndarray)):
        return str([value(x) for x in v])
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        # pandas holds integers of a column with nulls as floats
        return str(int(v)) if float(v).is_integer() else repr(float(v))
    return str(int(v)) if isinstance(v, (int, np.integer)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(([value(v) for v in r] for r in df.astype(object).values.tolist()), key=str)
