"""Every query with a SQL twin gives the twin's rows."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    assert compare(entry.queries()[name](spark, sf), duck, entry.oracle_sql()[name]) == []


def test_entry_is_flagship(spark):
    assert set(entry.entry(spark).columns) == {"insurance_type", "reason_code", "n_denied"}


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
