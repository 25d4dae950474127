"""Every query against its SQL, and those without SQL for rows."""

import pytest

from spoolworks.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, compare):
    compare(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[0] == "project_id"
    assert set(e.oracle_sql()) <= set(e.queries())
