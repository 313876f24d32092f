"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quarrystone.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(pdf, columns):
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) else v
    return sorted((tuple(plain(v) for v in r) for r in pdf[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    got, want = registry.queries()[name](spark, DIR).toPandas(), db.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
