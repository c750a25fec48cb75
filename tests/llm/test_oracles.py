import pytest

from seamark.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], sf) > 0
