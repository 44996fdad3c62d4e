"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from tallywire.checks.base import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name)) is None


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["window_start", "score", "summary"]
    assert out.limit(1).count() == 1
