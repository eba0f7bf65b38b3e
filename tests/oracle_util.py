"""Run a Spark query and its DuckDB oracle on the same tables and compare them
the way the driver does: row count, column names, order-insensitive values."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from credrisk.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, places: int):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, places)
        return 0.0 if r == 0 else r
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, places) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, places)) for k, x in v.items()))
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return int(v)
    return v


def rows(pdf: pd.DataFrame, places: int = 6) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v.item() if hasattr(v, "item") else v, places) for v in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark_df, sql: str, con, places: int = 6) -> tuple[bool, str]:
    s = spark_df.toPandas()
    d = con.execute(sql).df()
    if sorted(s.columns) != sorted(d.columns):
        return False, f"columns differ: spark={sorted(s.columns)} duck={sorted(d.columns)}"
    if len(s) != len(d):
        return False, f"row count differs: spark={len(s)} duck={len(d)}"
    rs, rd = rows(s, places), rows(d, places)
    if rs != rd:
        for a, b in zip(rs, rd):
            if a != b:
                return False, f"first differing row:\n spark={a}\n duck ={b}\n cols={sorted(s.columns)}"
    return True, f"{len(s)} rows equal"
