"""Every registered query against its SQL, and the entry point contract."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from tankline.plans.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    sql = ORACLES.get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, con, sql) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["organization", "day", "value"] and df.count() > 0


def test_all_queries_have_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
