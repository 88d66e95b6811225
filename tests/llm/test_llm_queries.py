import pytest

import oracle
from quillon.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, data, name):
    assert oracle.compare(spark, oracle.connect(data), name, Q.QUERIES[name], Q.SQL[name], data) is None


@pytest.mark.parametrize("name", sorted(Q.QUERIES.keys() - Q.SQL.keys()))
def test_runs(spark, data, name):
    assert Q.QUERIES[name](spark, data).count() > 0
