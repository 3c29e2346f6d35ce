"""Every registered query runs; those with SQL agree with it at the smallest scale."""
import pytest

from __spark_entry__ import REGISTRY, entry, oracle_sql, queries
from check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", REGISTRY)
def test_query(spark, con, name):
    status, _, note = compare(spark, con, name, FOLDER)
    assert status in ("ok", "rows-only"), note


def test_entry_and_contract(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
