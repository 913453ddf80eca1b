"""Compares a query with its SQL over the same tables."""

from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return None
        if isinstance(x, bool) or str(type(x)).endswith("bool'>") or str(type(x)).endswith("bool_'>"):
            return bool(x)
        try:
            return round(float(x), 6) + 0.0
        except (TypeError, ValueError):
            return str(x)

    rows = [tuple(value(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)]
    return sorted(rows, key=str)


def differences(spark_df, con, sql: str) -> tuple[int, int, list]:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), (sorted(got.columns), sorted(want.columns))
    a, b = plain(got), plain(want)
    return len(a), len(b), [(x, y) for x, y in zip(a, b) if x != y][:3]
