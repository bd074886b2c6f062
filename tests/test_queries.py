"""Every registered query against its SQL twin, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, small, name):
    assert compare(spark, small, name) is None


def test_every_query_has_a_twin():
    assert set(entry.QUERIES) == set(entry.ORACLE)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r["rank"] for r in rows} == set(range(1, 11))
