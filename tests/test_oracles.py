import pytest
from oracle import connect, differences

from provenir.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    n, m, different = differences(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name])
    assert n == m and n > 0
    assert not different
