"""Every registered query against its DuckDB statement."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
# All posts of the smallest tables have a given vector.
EMPTY = {"posts_to_classify"}


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, connection, name):
    problem = compare(spark, connection, SF_DIR, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem == ("EMPTY on both sides" if name in EMPTY else "")


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
