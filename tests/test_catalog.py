import pytest
from oracle import same

from phyloquarry.plans import consensus_catalog, file_catalog, forest_catalog, model_catalog, tree_catalog  # noqa: F401
from phyloquarry.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_against_sql(spark, name):
    build, sql = QUERIES[name]
    same(spark, build, sql, SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_runs(spark, name):
    assert QUERIES[name][0](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
