"""Every registered query beside its SQL twin, on whole tables."""

import pytest
from check import compare, connect

import __spark_entry__ as entry
from tonetide.plans import catalog

SF = "/root/testdata/sf0.001"
# corpus queries have tests of their own
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF)
    assert compare(frame, con, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
