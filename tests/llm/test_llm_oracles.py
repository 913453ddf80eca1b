import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import connect, differences  # noqa: E402

from provenir.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    n, m, different = differences(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])
    assert n == m and n > 0
    assert not different
