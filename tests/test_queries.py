"""Every core query against its SQL on the smallest tables."""

import pytest

import oracle
from quillon.plans import data_problems, image_queries, package_queries, provenance_queries, screen_queries, stream_queries, text_queries

MODULES = (data_problems, image_queries, package_queries, provenance_queries, screen_queries, stream_queries, text_queries)
PAIRS = [(n, m.QUERIES[n], m.SQL[n]) for m in MODULES for n in m.QUERIES if n in m.SQL]


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name,query,sql", PAIRS, ids=[p[0] for p in PAIRS])
def test_equals_sql(spark, data, con, name, query, sql):
    assert oracle.compare(spark, con, name, query, sql, data) is None


def test_queries_without_sql_run(spark, data):
    for m in MODULES:
        for n in m.QUERIES.keys() - m.SQL.keys():
            assert m.QUERIES[n](spark, data).count() > 0, n


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["src_table", "row_id", "reason"]
