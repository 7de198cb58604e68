"""Queries see all tips, sites and cells of their tables; messages against brute force."""

from collections import Counter, defaultdict
from math import exp, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from phyloquarry.operators import likelihood, messages
from phyloquarry.plans import catalog, model_catalog
from phyloquarry.plans.views import view

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_views_hold_all_tips_and_sites(spark):
    nodes = view(spark, SF, "nodes")
    assert {r["count"] for r in nodes.groupBy("tree").count().collect()} == {132}  # FIXTURES.md
    assert view(spark, SF, "node_gt").agg(F.count_distinct("site")).first()[0] == 2000


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 16])
def test_cell_tree_joins_all_cells(n):
    tree = catalog.cell_tree(n)
    below = Counter(p for p in tree.parent if p >= 0)
    assert len(tree.parent) == len(tree.length) == 2 * n and below.pop(tree.root) == 1
    assert all(c == 2 for c in below.values()) and set(below) == set(range(n, 2 * n - 1))
    assert all(p > i for i, p in enumerate(tree.parent) if p >= 0)


def test_log_likelihood_uses_every_cell(spark):
    tree, reads = catalog.all_cells(view(spark, SMALL, "reads"))
    assert tree.n_tips > 4
    leaf = defaultdict(dict)
    for r in catalog._leaf_likelihoods(reads.where("site < 6")).collect():
        leaf[r.site][r.cell] = r.lik
    p = catalog._cell_matrices(tree)

    def partial(node, g, tips):
        if node < tree.n_tips:
            return exp(tips[node][g])
        return np.prod([sum(p[c][g, h] * partial(c, h, tips) for h in range(4)) for c in tree.children(node)])

    found = {r.pattern: r.log_likelihood for r in catalog.t02_tree_log_likelihood(view(spark, SMALL, "reads")).collect()}
    for site in list(leaf)[:3]:
        assert found[site] == pytest.approx(log(partial(tree.root, 0, leaf[site])), abs=1e-5)


def test_messages_and_patterns_of_all_cells(spark):
    build = lambda name: catalog.QUERIES[name][0](spark, SMALL).collect()
    reads = view(spark, SMALL, "reads")
    tree, numbered = catalog.all_cells(reads)
    rows = {(r.site, r.cell): r.cov for r in numbered.collect()}
    p = [likelihood.transition(model_catalog.Q4, t) for t in tree.length]
    want, moved = defaultdict(float), {}
    for (site, cell), cov in rows.items():
        lik = [-(cov % (s + 3)) / 2.0 for s in range(4)]
        up = tree.parent[cell]
        for g in range(4):
            want[site, up, g] += log(sum(exp(x) * p[cell][g, s] for s, x in enumerate(lik)))
        for s, x in enumerate(lik):
            if p[cell][(site + up) % 4, s] > 0:
                moved[site, cell, s] = x + log(p[cell][(site + up) % 4, s])
    found = {(r.pattern, r.parent, r.from_state): r.message for r in build("j16_contracted_messages")}
    assert found == pytest.approx(dict(want), abs=2e-6)
    assert {(r.pattern, r.node, r.state): r.transfer for r in build("t11_transfer")} == pytest.approx(moved, abs=2e-6)
    alleles = defaultdict(dict)
    for r in view(spark, SMALL, "calls").collect():
        alleles[r.site][r.cell] = r.genotype
    patterns = Counter((s % 200, ",".join(str(a[c]) for c in sorted(a))) for s, a in alleles.items())
    assert {(r.pattern, r.alleles): r.weight for r in build("a44_allele_patterns")} == patterns


def test_chosen_genotypes_meet_before_transitions_multiply_rows(spark):
    children = spark.createDataFrame([("p", 0, s, -float(s)) for s in (0, 1)], "pattern string, node int, state int, loglik double")
    branches = spark.createDataFrame([(0, 5, g, h, -1.0 - g - 2 * h) for g in (0, 1) for h in (0, 1) if (g, h) != (1, 1)], "node int, parent int, from_state int, state int, log_p double")
    chosen = spark.createDataFrame([("p", 5, 1)], "pattern string, node int, state int")
    found = messages.transfer(children, chosen, branches)
    assert list(map(tuple, found.collect())) == [("p", 0, 0, -2.0)]
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "pattern#" in x]
    assert joins and not any("from_state#" in x for x in joins)
