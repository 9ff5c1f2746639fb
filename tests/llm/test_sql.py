"""Queries of this package that SQL can express, against it."""

import pytest

from compare import connect, differences
from wardline.llm import queries as Q


@pytest.mark.parametrize("key", Q.oracle_sql())
def test_query_equals_sql(spark, sf_dir, key):
    result = Q.queries()[key](spark, sf_dir)
    assert differences(result.toArrow(), connect(sf_dir).execute(Q.oracle_sql()[key]).to_arrow_table()) == []
