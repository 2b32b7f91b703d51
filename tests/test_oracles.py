"""Every query that has checking SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, connect


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, small, duck, name):
    count, verdict = compare(spark, duck, name, small)
    assert verdict in ("ok", "EMPTY"), verdict


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "rel_mean" in df.columns
