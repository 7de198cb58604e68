"""Clade fingerprints and annotated trees, on ladders and against the same summaries in plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phyloquarry.operators import consensus, forest, trees
from phyloquarry.sources import newick


def ladder(spark, n):
    """Inner nodes i0 .. in-1 in one line, a tip at each, two at the last."""
    rows = spark.range(n).select(F.lit(0).alias("tree"), F.concat(F.lit("i"), "id").alias("node"), F.when(F.col("id") > 0, F.concat(F.lit("i"), F.col("id") - 1)).alias("parent"), (n - F.col("id")).cast("double").alias("height"))
    tips = spark.range(n + 1).select(F.lit(0).alias("tree"), F.concat(F.lit("t"), "id").alias("node"), F.concat(F.lit("i"), F.least("id", F.lit(n - 1))).alias("parent"), F.lit(0.0).alias("height"))
    return rows.unionByName(tips)


def test_a_ladder_of_ten_thousand_levels(spark):
    n = 10_000
    nodes = ladder(spark, n)
    prints = consensus.fingerprints(nodes)
    assert prints.count() == 2 * n + 1 == prints.select("clade").distinct().count()
    sizes = {r.node: r["size"] for r in prints.where("node IN ('i0', 'i9999', 'i5000', 't3')").collect()}
    assert sizes == {"i0": n + 1, "i9999": 2, "i5000": 5001, "t3": 1}
    levels = {r.node: r.level for r in forest.levels(nodes.limit(nodes.count())).where("node IN ('i0', 'i9999', 't3')").collect()}
    assert levels == {"i0": n, "i9999": 1, "t3": 0}


def test_fingerprints_tell_what_texts_tell(spark):
    rows = [(t, f"n{i}", f"n{(i - 1) // 2}" if i else None, float(10 - i)) for t in range(3) for i in range(15)]
    rows = [(t, n, p if not (t == 1 and n == "n9") else "n5", h) for t, n, p, h in rows]
    nodes = spark.createDataFrame(rows, "tree long, node string, parent string, height double")
    met = trees.clades(nodes).join(consensus.fingerprints(nodes).withColumnRenamed("clade", "print"), ["tree", "node"])
    assert met.select("clade", "print").distinct().count() == met.select("clade").distinct().count() == met.select("print").distinct().count()
    with pytest.raises(ValueError, match="cycle"):
        consensus.fingerprints(spark.createDataFrame([(0, "a", "b"), (0, "b", "a")], "tree long, node string, parent string"))


@pytest.fixture(scope="module")
def sampled(spark):
    """Four samples of ((a,b),(c,d)) and one of ((a,c),(b,d)), with a trunk; heights and rates vary but for those of tips."""
    rng, rows = np.random.default_rng(5), []
    for t in range(5):
        pairs = [("a", "b"), ("c", "d")] if t != 2 else [("a", "c"), ("b", "d")]
        h = 1 + rng.random(4).cumsum()
        rows += [(t, "root", None, h[3], 1.0), (t, "trunk", "root", h[2], 1.0)]
        for k, pair in enumerate(pairs):
            rows += [(t, f"p{t}{k}", "trunk", h[k], float(rng.random()))] + [(t, x, f"p{t}{k}", 0.0, 2.0) for x in pair]
    rows = [(t, n, p, float(h), float(r)) for t, n, p, h, r in rows]
    return rows, spark.createDataFrame(rows, "tree long, node string, parent string, height double, rate double")


@pytest.mark.parametrize("option", ["keep", "mean", "median"])
def test_annotations(spark, sampled, tmp_path, option):
    rows, nodes = sampled
    found = consensus.annotated_tree(nodes, ["rate", "length"], heights=option)
    tree = {r.node: r for r in found.collect()}
    best = {r.tree for r in tree.values()}
    assert best == {0}
    same = [t for t in range(5) if t != 2]
    height = {(t, n): h for t, n, _, h, _ in rows}
    for name, k in (("p00", 0), ("p01", 1)):
        values = sorted(height[t, f"p{t}{k}"] for t in same)
        meta = tree[name].meta
        assert float(meta["posterior"]) == 0.8 and float(meta["height"]) == pytest.approx(np.mean(values)) and float(meta["height_median"]) == pytest.approx(np.median(values))
        assert [float(x) for x in meta["height_range"].strip("{}").split(",")] == [values[0], values[-1]] == [float(x) for x in meta["height_95%_HPD"].strip("{}").split(",")]
        shown = {"keep": height[0, name], "mean": np.mean(values), "median": np.median(values)}[option]
        assert tree[name].height == pytest.approx(shown)
    roots = [height[t, "root"] for t in range(5)]
    assert float(tree["root"].meta["height"]) == pytest.approx(np.mean(roots)) and tree["root"].meta["posterior"] == "1.0" and tree["trunk"].meta["posterior"] == "1.0"
    assert float(tree["trunk"].meta["height"]) == pytest.approx(np.mean([height[t, "trunk"] for t in range(5)]))
    assert tree["a"].meta["rate"] == "2.0" and "rate_median" not in tree["a"].meta and "rate_range" not in tree["a"].meta and "posterior" not in tree["a"].meta
    texts = newick.to_newick(found).first().newick, newick.to_newick(found, notes=False).first().newick
    assert "[&" in texts[0] and "[" not in texts[1]
    (tmp_path / "t.tree").write_text("\n".join(r.value for r in newick.nexus(newick.to_newick(found)).collect()))
    back = {r.label: r for r in newick.read_tree(spark, str(tmp_path / "t.tree")).collect()}
    assert {k: (round(r.height, 6), {a: str(b) for a, b in r.meta.items()}) for k, r in back.items()} == {k: (round(r.height, 6), dict(r.meta or {})) for k, r in tree.items()}


def test_nothing_to_annotate(sampled):
    with pytest.raises(ValueError):
        consensus.annotated_tree(sampled[1].where("false"), ["rate"])
