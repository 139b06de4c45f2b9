"""Every registered query runs; those with an SQL twin give the same rows and types."""

import os

import pytest

import __spark_entry__ as contract
from compare import connect, difference, run_spark, run_sql

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "mean_value" in df.columns


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    ours = run_spark(QUERIES[name], spark, SF)
    if name in ORACLES:
        assert difference(ours, run_sql(con, ORACLES[name])) is None
    else:
        assert ours[2]
