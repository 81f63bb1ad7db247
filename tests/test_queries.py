"""Every registered query with SQL, on the smallest scale, value by value."""

import os

import pytest
from oracle import compare, connect, forbidden_joins

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert compare(df, con, ORACLES[name]) is None
    assert forbidden_joins(df) == []


def test_entry(spark):
    df = entry.entry(spark)
    assert {"alert_seq", "threat_score", "severity"} <= set(df.columns)
    assert df.count() > 0


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)
