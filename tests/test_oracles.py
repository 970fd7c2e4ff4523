"""Every registered query runs, and equals its SQL where it has one."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import compare, database

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], SQL.get(name), FOLDER)
    assert ok, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
