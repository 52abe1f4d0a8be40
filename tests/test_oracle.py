"""Every registered query against DuckDB on the same tables."""

import pytest

import soundcheck.catalog  # noqa: F401 - registers the queries
from soundcheck.catalog.base import ORACLE, QUERIES
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_duckdb(spark, con, name):
    problems = compare(spark, con, name, SMALL)
    # Few rows at this size: some questions have an empty answer.
    assert [p for p in problems if p != "no rows"] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
