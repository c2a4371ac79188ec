"""Every query that has a SQL twin, compared on the smallest tables."""
import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, open_tables

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return open_tables(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, small, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLE[name], small)
    assert ok, note


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
