"""Comparing a query with its SQL twin in DuckDB."""

import math
from pathlib import Path

import duckdb


def canonical(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    twin = con.sql(sql)
    assert sorted(df.columns) == sorted(twin.columns)
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(twin.columns, twin.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
    return len(ours)
