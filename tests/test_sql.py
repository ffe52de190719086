"""Every registered query equals its SQL twin."""

import pytest
import sqlcheck

import __spark_entry__ as entry
from skyspine import workload

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = workload.queries(), workload.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return sqlcheck.duck(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query(spark, con, key):
    assert sqlcheck.compare(QUERIES[key](spark, SF), con, ORACLE[key]) == ""


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
