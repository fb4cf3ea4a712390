"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from weftspark.plans import graph, live, programs, tiles, trace

ALL = {**trace.QUERIES, **tiles.QUERIES, **graph.QUERIES, **programs.QUERIES, **live.QUERIES}
SQL = {**trace.SQL, **tiles.SQL, **graph.SQL, **programs.SQL, **live.SQL}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{t}{'/*' if os.path.isdir(f'{sf}/{t}') else ''}')")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c].dtype) and not pd.api.types.is_bool_dtype(df[c].dtype):
            df[c] = df[c].astype(float).round(9)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda x: x if x is None or isinstance(x, str) else None if pd.isna(x) else str(x))
    return df.sort_values(list(df.columns), kind="stable", na_position="last").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, sf, name):
    ours, theirs = plain(ALL[name](spark, sf).toPandas()), plain(duck.execute(SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs)
    for c in ours.columns:
        assert ((ours[c] == theirs[c]) | (ours[c].isna() & theirs[c].isna())).all(), c


def test_every_query_has_sql():
    assert set(ALL) == set(SQL)
