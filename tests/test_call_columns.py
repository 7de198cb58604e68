"""Sites called from their own columns: the same calls as by patterns, found once and without rows of patterns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phyloquarry.operators import calling, calls, likelihood
from phyloquarry.plans import forest_catalog
from phyloquarry.plans.views import view

SMALL = "/root/testdata/sf0.001"
NODES = [("c0", "g0", 0.4), ("c1", "g0", 0.5), ("c2", "top", 0.8), ("g0", "top", 0.3), ("top", "root", 0.2), ("root", None, None)]


def leaf_of():
    """Likelihoods with ties where counts are equal, as a function that workers need not import."""

    def leaf(counts):
        lik = -np.stack([counts[:, 0], counts[:, 1], counts[:, 1], counts[:, 0] + counts[:, 1]], axis=1) / 2.0
        return lik, np.stack([lik, lik - counts[:, :1] + 1.0], axis=2)

    return leaf


def test_columns_have_the_calls_of_patterns(spark):
    tree = calling.tree_of(NODES, ["c0", "c1", "c2"])
    rates, shares = [0.5, 1.5], [0.5, 0.5]
    matrices = [[likelihood.transition(likelihood.rate_matrix(4), r * t) for t in tree.length] for r in rates]
    rng = np.random.default_rng(5)
    data = {site: rng.integers(0, 6, (3, 2)) if site else np.zeros((3, 2), int) for site in range(30)}
    columns = spark.createDataFrame([(s, x.ravel().tolist(), f"n{s}") for s, x in data.items()], "site long, counts array<long>, name string")
    found = calling.called_columns(columns, 2, leaf_of(), tree, matrices, shares).collect()
    cells = [(s, c, c, *(v[c].tolist() for v in leaf_of()(x))) for s, x in data.items() for c in range(3)]
    rows = spark.createDataFrame(cells, "site long, cell int, place int, lik array<double>, parts array<array<double>>")
    called = calling.called(rows.select(F.col("site").alias("pattern"), "cell", "lik"), tree, matrices, shares)
    sites = spark.createDataFrame([(s, s) for s in data], "site long, pattern long")
    want = {(r.site, r.option, r.cell): r for r in calling.called_cells(called, sites, rows).collect()}
    assert len(want) == 3 * len(found) and any(r.option for r in found)
    for r in found:
        assert r.name == f"n{r.site}" and r.counts == data[r.site].ravel().tolist()
        for c in range(3):
            w = want[r.site, r.option, c]
            assert (r.genotypes[c], r.ado[c]) == (w.genotype, w.ado) and r.constant == pytest.approx(w.constant)
            assert np.allclose(r.liks[4 * c : 4 * c + 4], w.liks) and np.allclose(r.ado_liks[2 * c : 2 * c + 2], w.ado_liks)


def test_first_assignments_are_marked_where_they_are_the_only_ones():
    tree = calling.tree_of(NODES, ["c0", "c1", "c2"])
    matrices = [likelihood.transition(likelihood.rate_matrix(4), t) for t in tree.length]
    x = np.concatenate([np.random.default_rng(1).normal(-4, 3, (3, 40, 4)), np.full((3, 1, 4), -1e4) + [0, 1e4, 1e4, 0]], axis=1)
    states, only = likelihood.first_assignments(tree, likelihood.tied_choices(x, tree, matrices, 1e-9)[1], 41)
    for k, (_, ways) in enumerate(likelihood.max_sum(x, tree, matrices)):
        assert only[k] == (len(ways) == 1) and tuple(states[k]) == ways[0]


def test_a_site_without_all_cells_is_an_error(spark):
    tree = calling.tree_of(NODES, ["c0", "c1", "c2"])
    matrices = [[likelihood.transition(likelihood.rate_matrix(4), t) for t in tree.length]]
    columns = spark.createDataFrame([(1, [1, 2, 3, 4])], "site long, counts array<long>")
    with pytest.raises(Exception, match="without the counts"):
        calling.called_columns(columns, 2, leaf_of(), tree, matrices, [1.0]).collect()


@pytest.mark.parametrize("name", ["k05_called_records", "t10_called_cells"])
def test_sites_are_called_once(spark, name):
    names = {"k05_called_records": ["cell_nodes", "sites", "reads"], "t10_called_cells": ["cell_nodes", "reads"]}[name]
    plan = getattr(forest_catalog, name)(*(view(spark, SMALL, n) for n in names))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("MapIn" in line for line in plan.splitlines()) == 1


def test_records_take_each_cell_once(spark):
    given = [(1, c, ["C"], "0/1", ["C", "T"], [3, 4], 5, 12, [-1.0, -2.0, -3.0, -4.0], [-1.0, -2.0], 0) for c in range(2)]
    cells = spark.createDataFrame(given, "site long, cell int, alts array<string>, alphabet string, nucs array<string>, reads array<long>, ref_reads long, cov long, liks array<double>, ado_liks array<double>, ado int")
    made = calls.records(cells, spark.createDataFrame([(1, "chr1", 9, "A")], "site long, chrom string, pos long, ref string"))
    field = "0/1:5,3:12:5:0,5,9,13:0:5:0,5"
    assert [r.record for r in made.collect()] == [f"chr1\t9\t.\tA\tC\t.\tPASS\tAC=2;AF=0.500;AN=4;DP=24\t{calls.FIELDS}\t{field}\t{field}"]
    joins = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 1
