"""Every registered query against its SQL on the smallest given tables."""

import os

import compare
import pytest

import __spark_entry__ as spark_entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = spark_entry.queries(), spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_sql_names_are_registered():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert compare.differences(result, con, SQL[name]) is None
    else:
        assert result.count() > 0


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 10
