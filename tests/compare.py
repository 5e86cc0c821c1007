"""Rows as text, for comparing a query with its oracle."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

from tessera.sources.adapters import TABLES


def shown(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)):
        return repr(round(float(v), 9) + 0.0)
    return str(v)


def as_text(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(map(shown, row)) for row in df[sorted(df.columns)].itertuples(index=False))


def oracle_rows(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()
