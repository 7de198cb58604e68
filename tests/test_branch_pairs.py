"""Events between genotypes without making the pairs twice."""

import pytest

from phyloquarry.operators import genes
from phyloquarry.plans import model_catalog
from phyloquarry.plans.views import view


def test_events_of_many_rows_and_none(spark):
    told = [("0/0", "0/1"), ("0/1", "0/0"), ("1/1", "0/1"), ("0/0", "1/1"), ("0/1", "0/01")]
    rows = [(i, *told[i % 5]) for i in range(2000)] + [(-1, None, "0/1"), (-2, "0/1", None)]
    pairs = spark.createDataFrame(rows, "site long, parent_gt string, child_gt string").repartition(3)
    found = {r.site: r.events for r in genes.difference_events(pairs).collect()}
    assert found == {i: genes.pair_events(*told[i % 5]) for i in range(2000)}
    assert genes.difference_events(pairs.where("false")).count() == 0
    with pytest.raises(Exception, match="Not a possible transition"):
        genes.difference_events(spark.createDataFrame([("1/-", "0/1")], "parent_gt string, child_gt string")).collect()


def test_pairs_are_made_once_and_tips_are_no_parents(spark):
    plan = model_catalog.f17_events_by_difference(*(view(spark, "/root/testdata/sf0.001", n) for n in ("nodes", "node_gt")))
    lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [x for x in lines if "Join" in x]
    assert sum("parent_gt" in x and "child_gt" in x for x in joins) <= 1 and any("LeftSemi" in x for x in joins)
    assert sum("site#" in x and "parent#" in x and "Inner" in x for x in joins) == 1
