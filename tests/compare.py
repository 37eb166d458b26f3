"""Rows of a query and of its SQL, made comparable."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return int(v) if float(v).is_integer() else round(float(v), 6)
    return v


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(map(plain, r)) for r in df[names].itertuples(index=False, name=None)), key=repr)


def of_sql(sql, data=DATA):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in data.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return rows(con.execute(sql).df())
