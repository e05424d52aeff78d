"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF)
    assert ok, f"{name}: {note}"


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.columns and df.limit(1).count() == 1


def test_checks_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
