"""Every query with an SQL twin gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tidemark.plans.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return int(v)
    return v.item() if hasattr(v, "item") else v


def rows(frame):
    found = [tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)]
    return sorted(found, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, db, name):
    ours, theirs = queries()[name](spark, DATA).toPandas(), db.execute(oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    assert queries()[name](spark, DATA).count() > 0
