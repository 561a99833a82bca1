"""Every query that SQL can express against DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from lumengrid import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        df[k] = df[k].map(lambda v: None if v is None else float(v) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)) else str(v))
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    a, b = normal(ours), normal(theirs)
    for k in a.columns:
        same = (a[k] == b[k]) | (a[k].isna() & b[k].isna())
        assert same.all(), f"{k}: {a[k][~same].iloc[0]} and {b[k][~same].iloc[0]}"


def test_every_query_has_sql_or_a_test():
    without = set(catalog.QUERIES) - set(catalog.SQL)
    assert without == {"q13_error_diffusion", "e02_range_coded_streams", "e16_general_codecs", "j14_separate_peaks", "t07_mdl_tree", "p20_predictive_index", "q14_predictive_dequantisation", "e03_adaptive_binary", "s16_container_shares", "a18_model_frequencies", "p16_quadratic_residuals", "m19_router_streams", "p20_predictive_planes"}
