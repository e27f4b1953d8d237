"""Every registered query with SQL, at the smallest scale, against the SQL."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def canon(v):
    if isinstance(v, (bool, int, decimal.Decimal)):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    ours = sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = con.sql(SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert ours == sorted((tuple(canon(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
