"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 4


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, sf, name):
    ok, note = compare(spark, con, sf, name)
    assert ok, note
