"""Every registered query beside its SQL, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, connection

FOLDER = os.environ.get("MARGINALIA_TABLES", "/root/testdata/sf0.001")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    rows, differences, types = compare(QUERIES[name](spark, FOLDER), con, ORACLES[name])
    assert rows > 0
    assert not differences
    assert not types


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["uuid", "folder_path", "last_modified", "highlights"]
