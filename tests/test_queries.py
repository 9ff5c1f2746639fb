"""Every registered query against its SQL on the same tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences

OTHERS = set(entry.LLM.queries()) if entry.LLM else set()  # tested on their own
QUERIES = {key: query for key, query in entry.queries().items() if key not in OTHERS}
SQL = {key: sql for key, sql in entry.oracle_sql().items() if key not in OTHERS}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("key", QUERIES)
def test_query_equals_sql(spark, sf_dir, con, key):
    result = QUERIES[key](spark, sf_dir)
    assert differences(result.toArrow(), con.execute(SQL[key]).to_arrow_table()) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
