"""Likelihoods of tables of trees against the array kernel, one tree and pattern at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phyloquarry.operators import forest, likelihood

Q = likelihood.rate_matrix(4)
NODES = "tree long, node string, parent string, length double, label string"


def drawn(seed, n_tips):
    """Parents and lengths of a random tree with a trunk; tips are 0 .. n_tips - 1."""
    draw = random.Random(seed)
    open_nodes, parent, lengths = list(range(n_tips)), {}, {}
    node = n_tips
    while len(open_nodes) > 1:
        for x in [open_nodes.pop(draw.randrange(len(open_nodes))) for _ in range(min(draw.choice([2, 2, 3]), len(open_nodes)))]:
            parent[x], lengths[x] = node, draw.random()
        open_nodes.append(node)
        node += 1
    parent[open_nodes[0]], lengths[open_nodes[0]] = node, 0.3
    parent[node], lengths[node] = -1, 0.0
    return likelihood.Tree(tuple(parent[i] for i in range(node + 1)), tuple(lengths[i] for i in range(node + 1)), n_tips)


def rows_of(number, tree):
    name = lambda i: None if i < 0 else f"x{i}"
    return [(number, name(i), name(p), t, f"cell{i}" if i < tree.n_tips else None) for i, (p, t) in enumerate(zip(tree.parent, tree.length, strict=True))]


@pytest.fixture(scope="module")
def given(spark):
    rng = np.random.default_rng(3)
    trees = {k: drawn(k, 6) for k in range(3)}
    leaves = {p: rng.normal(-3, 2, (6, 4)) for p in range(5)}
    rows = [(f"p{p}", f"cell{c}", x[c].tolist()) for p, x in leaves.items() for c in range(6)]
    nodes = spark.createDataFrame([r for k, t in trees.items() for r in rows_of(k, t)], NODES)
    return trees, leaves, nodes, spark.createDataFrame(rows, "pattern string, label string, lik array<double>")


def expected(trees, leaves, rates, shares, masked=False):
    out = {}
    for k, t in trees.items():
        for p, x in leaves.items():
            x = np.where(np.arange(4) == 0, x, -1e4) if masked else x
            parts = [np.log(s) + likelihood.sum_product(x[:, None, :], t, [likelihood.transition(Q, r * d) for d in t.length])[0, 0] for r, s in zip(rates, shares, strict=True)]
            out[k, f"p{p}"] = float(np.logaddexp.reduce(parts))
    return out


@pytest.mark.parametrize("cut", [8, 1])
def test_log_likelihoods(given, monkeypatch, cut):
    monkeypatch.setattr(forest, "CUT", cut)
    trees, leaves, nodes, partials = given
    rates, shares = [0.2, 1.0, 3.0], [0.25, 0.25, 0.5]
    roots = forest.root_partials(partials, forest.branches(nodes, Q, rates))
    found = {(r.tree, r.pattern): r for r in forest.pattern_log_likelihoods(roots, shares).collect()}
    want, constant = expected(trees, leaves, rates, shares), expected(trees, leaves, rates, shares, masked=True)
    assert set(found) == set(want)
    for k, r in found.items():
        assert r.log_likelihood == pytest.approx(want[k], abs=1e-9) and r.constant == pytest.approx(constant[k], abs=1e-9)
    best = {(r.tree, r.pattern): r.category for r in forest.best_categories(roots, shares).collect()}
    for k, t in trees.items():
        for p, x in leaves.items():
            each = [np.log(s) + likelihood.sum_product(x[:, None, :], t, [likelihood.transition(Q, r * d) for d in t.length])[0, 0] for r, s in zip(rates, shares, strict=True)]
            assert best[k, f"p{p}"] == int(np.argmax(each))


def test_corrections(given, spark):
    trees, leaves, nodes, partials = given
    weights = {f"p{p}": p + 1 for p in leaves}
    table = spark.createDataFrame(list(weights.items()), "pattern string, weight long")
    found = forest.pattern_log_likelihoods(forest.root_partials(partials, forest.branches(nodes, Q, [1.0])), [1.0])
    want, constant = expected(trees, leaves, [1.0], [1.0]), expected(trees, leaves, [1.0], [1.0], masked=True)
    for kind in (None, "lewis", "mean", "geometric"):
        for r in forest.tree_log_likelihoods(found, table, kind, 40.0).collect():
            c, w = np.array([constant[r.tree, p] for p in weights]), np.array(list(weights.values()))
            extra = {None: 0, "lewis": -(w * np.log1p(-np.exp(c))).sum(), "mean": 40 * (np.log((w * np.exp(c)).sum()) - np.log(w.sum())), "geometric": 40 * (w * c).sum() / w.sum()}[kind]
            assert r.log_likelihood == pytest.approx(sum(want[r.tree, p] * k for p, k in weights.items()) + extra)
    with pytest.raises(ValueError):
        forest.tree_log_likelihoods(found, table, "other")


def test_missing_tips_zero_lengths_and_nothing(given, spark):
    trees, leaves, nodes, partials = given
    branch = forest.branches(nodes.withColumn("length", F.lit(0.0)), Q, [1.0])
    found = forest.pattern_log_likelihoods(forest.root_partials(partials.where("label <> 'cell2'"), branch), [1.0]).collect()
    for r in found:
        x = leaves[int(r.pattern[1:])]
        assert r.log_likelihood == pytest.approx(sum(x[c, 0] for c in range(6) if c != 2))
    assert forest.root_partials(partials.where("false"), branch).count() == 0
    assert forest.levels(nodes.where("false")).count() == 0
    with pytest.raises(ValueError):
        forest.levels(spark.createDataFrame([(0, "a", "b"), (0, "b", "a"), (0, "c", None)], "tree long, node string, parent string"))


def test_transitions_and_deep_trees():
    for t in (0.0, 1e-6, 0.3, 40.0):
        assert np.allclose(forest.transitions(Q, np.array([t]))[0], likelihood.transition(Q, t), atol=1e-12)
    n = 3000
    ladder = likelihood.Tree((n, *(n + max(i - 1, 0) for i in range(1, n)), *range(n + 1, 2 * n - 1), -1), (0.1,) * (2 * n - 1), n)
    assert len(ladder.order()) == n - 1
    leaves = np.zeros((n, 1, 4))
    assert np.allclose(likelihood.sum_product(leaves, ladder, [likelihood.transition(Q, 0.1)] * (2 * n - 1)), 0, atol=1e-6)


def test_many_patterns_are_dealt_before_trees_multiply_them(given, spark):
    trees, _, nodes, _ = given
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rng = np.random.default_rng(5)
    leaves = {p: rng.normal(-3, 2, (6, 4)) for p in range(n)}
    rows = [(f"p{p}", f"cell{c}", x[c].tolist()) for p, x in leaves.items() for c in range(6)]
    roots = forest.root_partials(spark.createDataFrame(rows, "pattern string, label string, lik array<double>"), forest.branches(nodes, Q, [0.5, 2.0]))
    assert "hashpartitioning(tree" not in roots._jdf.queryExecution().executedPlan().toString()
    want = expected(trees, leaves, [0.5, 2.0], [0.5, 0.5])
    found = forest.pattern_log_likelihoods(roots, [0.5, 0.5]).collect()
    assert {(r.tree, r.pattern): r.log_likelihood for r in found} == pytest.approx(want, abs=1e-9)


def test_messages_keep_far_apart_partials(spark):
    rows = [(-1e4, -1.0, -9e3, -700.0), (-2.0, -1400.0, -740.0, -3.0), (0.0, 2 * forest.LEAST, 2 * forest.LEAST, 2 * forest.LEAST)]
    p = ["p0", "p1", "p2", "p3"]
    moves = np.where(np.eye(4) > 0, 1 - 1e-9, [[0, 1e-9, 0, 0]] * 4)
    log_p = np.where(moves > 0, np.log(np.maximum(moves, 5e-324)), forest.LEAST)
    table = spark.createDataFrame(rows, "p0 double, p1 double, p2 double, p3 double").withColumn("log_p", F.array(*map(F.lit, log_p.ravel().tolist())))
    table = table.select("*", *[F.exp(F.get("log_p", F.lit(i))).alias(f"m{i}") for i in range(16)], *forest._scaled(p))
    for r in table.select(*p, F.array(*forest._message(p, 4)).alias("x")).collect():
        assert r.x == pytest.approx(np.logaddexp.reduce(log_p + np.array(r[:4]), axis=1).tolist(), rel=1e-12)
