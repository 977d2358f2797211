"""pN queries against their SQL, and the rest for rows."""

import oracle
import pytest

from marlstone.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    mine, theirs = oracle.both(spark, QUERIES, SQL, name, data)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
