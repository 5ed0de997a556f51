"""Every registered query against its oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from testbed.verify import ROOT, compare, connect

SF_DIR = f"{ROOT}/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    assert compare(spark, SF_DIR, name, QUERIES[name], SQL.get(name), oracle) is None


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
