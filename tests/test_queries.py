"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from paperloom import registry as documents

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["nation", "customer", "supplier", "orders", "lineitem", "documents", "pages", "conversations", "labels"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda x: None if pd.isna(x) else x.item() if hasattr(x, "item") else x
    return sorted((tuple(clean(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(documents.ORACLES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    expected = duck.execute(entry.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)

