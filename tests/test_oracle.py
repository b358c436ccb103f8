"""Every core query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from marlpit import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DIR}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def norm(df):
    df = df[sorted(df.columns)]

    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "NULL"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_as_sql(spark, con, name):
    ours, theirs = Q.QUERIES[name](spark, DIR).toPandas(), con.sql(Q.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert norm(ours) == norm(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
