"""Registered queries against their SQL at the smallest scale."""
from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    ok, note, _ = compare(spark, con, sf, name, QUERIES[name], ORACLE.get(name))
    assert ok, note
    assert "TYPES" not in note, note


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 25
