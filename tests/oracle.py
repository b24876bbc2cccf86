"""Compares a query's rows with those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def connect(folder: str):
    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        files = path if path.is_file() else f"{path}/*.parquet"
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return str(value)[:26] if hasattr(value, "isoformat") else value


def assert_same(df, db, sql):
    found = db.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    order = [found.columns.index(c) for c in df.columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    ours = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
    assert ours == theirs
