"""Every query with an SQL equivalent gives the rows that DuckDB gives on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from oddlight.plans import queries as engine

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(6) + 0.0
        df[c] = df[c].map(lambda v: list(v) if isinstance(v, np.ndarray) else v).astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = engine.QUERIES[name](spark, DATA).toPandas(), duck.execute(engine.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got).equals(canonical(want))


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLE_SQL)))
def test_runs(spark, name):
    assert engine.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
