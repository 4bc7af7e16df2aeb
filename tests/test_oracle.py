"""Every query with a SQL counterpart gives the same rows as DuckDB; the others run."""

import pytest
from compare import connect, difference

from matchspark.plans import registered

QUERIES, ORACLE = registered()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(name, spark, con, sf_dir):
    assert difference(QUERIES[name], ORACLE[name], spark, con, sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "match_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())
