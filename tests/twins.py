"""Holds a registered query against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value is pd.NA or value != value:
        return "~"
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}"
    return str(value)


def rows(frame) -> list:
    names = sorted(frame.columns)
    return sorted(tuple(map(plain, r)) for r in frame[names].astype(object).itertuples(index=False))


def check(spark, query, sql: str, folder: str = SMALL) -> None:
    base = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        base.execute(f"create view {f.stem} as select * from '{f}'")
    expected, found = base.execute(sql).df(), query(spark, folder).toPandas()
    assert sorted(expected.columns) == sorted(found.columns)
    assert rows(expected) == rows(found)
