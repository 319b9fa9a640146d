"""Rows of Spark and of DuckDB in one form."""

import os

import duckdb


def rows_of(df):
    df = df[sorted(df.columns)]

    def one(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v

    return sorted(str([one(v) for v in r]) for r in df.astype(object).itertuples(index=False, name=None))


def duck(sql, folder):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{folder}/{t}')")
    return con.execute(sql).fetchdf()
