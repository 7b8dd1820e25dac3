"""Every query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from turnwise import queries as own


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    as_text = lambda v: repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(as_text, r)) for r in df.where(df.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_agrees(spark, sf_dir, db, name):
    got = own.QUERIES[name](spark, sf_dir).toPandas()
    want = db.sql(own.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
