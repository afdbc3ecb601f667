"""Runs a query's SQL on DuckDB and compares the rows, whatever their order."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).iterdir():
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def cell(v) -> str:
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(cell, v)) + "]"
    if v is None or str(v) in ("<NA>", "NaT") or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if float(v).is_integer() else repr(round(float(v), 6))
    return str(v)[:19] if hasattr(v, "isoformat") else str(v)


def rows(frame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted(tuple(map(cell, r)) for r in frame[names].itertuples(index=False, name=None))


def assert_same(spark_frame, duck_frame) -> None:
    assert sorted(spark_frame.columns) == sorted(duck_frame.columns)
    assert rows(spark_frame) == rows(duck_frame)
