"""Trees deeper than any fixed number of levels, and cycles."""

import pytest

from phyloquarry.operators import trees

DEEP = 150


def caterpillar(spark):
    """Inner nodes i0 .. i149 in one line, a tip at each."""
    rows = [(0, f"i{k}", f"i{k - 1}" if k else None, float(DEEP - k)) for k in range(DEEP)]
    return spark.createDataFrame(rows + [(0, f"t{k}", f"i{k}", 0.0) for k in range(DEEP)], "tree int, node string, parent string, height double")


def test_deep_trees(spark):
    nodes = caterpillar(spark)
    above = trees.ancestors(nodes).collect()
    assert len(above) == len(set(above)) == DEEP * (DEEP + 1) // 2 + sum(k + 2 for k in range(DEEP))
    assert {r.ancestor: r.steps for r in above if r.node == f"t{DEEP - 1}"} == {f"t{DEEP - 1}": 0} | {f"i{k}": DEEP - k for k in range(DEEP)}
    sizes = {r.node: r["size"] for r in trees.clades(nodes).collect()}
    assert sizes["i0"] == DEEP and sizes[f"i{DEEP - 1}"] == 1 and sizes["t7"] == 1


def test_cycles_are_errors(spark):
    nodes = spark.createDataFrame([(0, "a", "c"), (0, "b", "a"), (0, "c", "b")], "tree int, node string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        trees.ancestors(nodes)


def test_texts_of_clades_are_no_keys_of_single_tips(spark):
    rows = [(t, x, p, h) for t in (0, 1) for x, p, h in [("r", None, 3.0), ("g", "r", 2.0), ("h", "r", 1.0), ("a", "g", 0.0), ("b", "g", 0.0), ("c", ("h", "g")[t], 0.0), ("d", "h", 0.0)]]
    nodes = spark.createDataFrame(rows, "tree int, node string, parent string, height double")
    clades = trees.clades(nodes).where("size > 1")
    first, second = (clades.where(f"tree = {t}") for t in (0, 1))
    common, inside = trees.common_ancestors(first, nodes), trees.subsets(first, second)
    assert sorted((r.clade, r.tree, r.node) for r in common.collect()) == sorted([("a,b,c,d", 0, "r"), ("a,b,c,d", 1, "r"), ("a,b", 0, "g"), ("a,b", 1, "g"), ("c,d", 0, "h"), ("c,d", 1, "r")])
    assert sorted(map(tuple, inside.collect())) == [("a,b", "a,b,c"), ("a,b", "a,b,c,d"), ("c,d", "a,b,c,d")]
    for found in (common, inside):
        plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not [x for x in plan if "Aggregate [" in x and any(c in x.split("]")[0] for c in ("clade#", "part#", "whole#"))]
