"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, sf, name):
    status, _, _ = compare(spark, con, sf, name, oracle_sql().get(name))
    assert status in ("ok", "rows-only"), status


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables missing")
def test_entry(spark):
    assert entry(spark).count() > 0
