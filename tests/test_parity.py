"""Every core query with SQL gives the SQL's rows; the others run and give rows."""

import oracle
import pytest

from marlstone.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    mine, theirs = oracle.both(spark, QUERIES, SQL, name, data)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() > 0


def test_no_python_in_sql_queries(spark, data):
    """What SQL can express stays in the JVM, but for the replayed source, which is Python by nature."""
    for name in ("bleu", "rouge_l_nostem", "theorems_plain", "cutoff_gap", "truncate_appendix"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


def test_filter_reaches_the_scan(spark, data):
    plan = QUERIES["scan_window"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(submitted_at" in plan and "full_text" not in plan
