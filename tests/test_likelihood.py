from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from phyloquarry.operators import likelihood as lk

TREE = lk.Tree(parent=(4, 4, 5, 5, 6, 6, 7, -1), length=(0.3, 0.3, 0.2, 0.2, 0.4, 0.5, 0.7, 0.0), n_tips=4)


def matrices():
    q = lk.rate_matrix(4)
    return [lk.transition(q, t) for t in TREE.length]


def brute(leaves, combine):
    m = matrices()
    scores = {}
    for states in product(range(4), repeat=8):
        if states[7] != 0:
            continue
        s = sum(np.log(m[i][states[TREE.parent[i]], states[i]]) if m[i][states[TREE.parent[i]], states[i]] > 0 else -np.inf for i in range(7))
        scores[states] = s + sum(leaves[i][states[i]] for i in range(4))
    return combine(scores)


def test_rate_matrix_rows_sum_to_zero_and_normalise():
    for n in (3, 4):
        q = lk.rate_matrix(n)
        assert np.allclose(q.sum(1), 0) and -np.trace(q) == pytest.approx(1)


def test_transition_is_stochastic_and_a_semigroup():
    q = lk.rate_matrix(4)
    assert np.allclose(lk.transition(q, 0.7).sum(1), 1)
    assert np.allclose(lk.transition(q, 0.3) @ lk.transition(q, 0.4), lk.transition(q, 0.7))


def test_gamma_rates():
    r = lk.gamma_rates(0.5, 4)
    assert r.mean() == pytest.approx(1) and (np.diff(r) > 0).all()


def test_sum_product_is_enumeration():
    leaves = np.log(np.random.default_rng(1).uniform(0.01, 1, (4, 3, 4)))
    found = lk.sum_product(leaves, TREE, matrices())
    for k in range(3):
        want = brute(leaves[:, k], lambda s: np.logaddexp.reduce(list(s.values())))
        assert found[k, 0] == pytest.approx(want)


def test_max_sum_is_enumeration_with_ties():
    leaves = np.log(np.random.default_rng(2).integers(1, 3, (4, 3, 4)).astype(float))
    for k, (score, assignments) in enumerate(lk.max_sum(leaves, TREE, matrices(), most=10_000)):
        scores = brute(leaves[:, k], dict)
        top = max(scores.values())
        assert score == pytest.approx(top)
        assert set(assignments) == {s for s, v in scores.items() if v >= top - 1e-9}


def test_recombination_crosses_what_fits(spark):
    rows = lambda found: spark.createDataFrame([(p, list(a)) for p, a in found], "pattern long, assignment array<int>")
    roots = rows([(0, (0, 0, 1)), (0, (0, 0, 2)), (0, (0, 1, 2)), (1, (3, 0, 0)), (1, (3, 0, 0))])
    subtrees = rows([(0, (9, 0, 5)), (0, (9, 0, 6)), (0, (9, 1, 7)), (1, (9, 2, 7))])
    found = [(r.pattern, tuple(r.assignment)) for r in lk.recombined(roots, subtrees, [2], 1).collect()]
    assert sorted(found) == [(0, (0, 0, 5)), (0, (0, 0, 6)), (0, (0, 1, 7))]


def test_dataframe_form(spark):
    rng = np.random.default_rng(3)
    lik = np.log(rng.uniform(0.01, 1, (5, 4, 4)))
    df = spark.createDataFrame([(p, c, lik[p, c].tolist()) for p in range(5) for c in range(4)], "pattern long, cell long, lik array<double>")
    found = {r.pattern: r.log_likelihood for r in lk.pattern_log_likelihoods(df, TREE, [matrices()], [1.0], [1.0, 0.0, 0.0, 0.0]).collect()}
    for p in range(5):
        assert found[p] == pytest.approx(brute(lik[p], lambda s: np.logaddexp.reduce(list(s.values()))))
    best = lk.best_assignments(df, TREE, matrices())
    assert best.select(F.count_distinct("pattern").alias("n")).first().n == 5


def test_best_assignments_has_every_tie(spark, monkeypatch):
    monkeypatch.setattr(lk, "ROWS", 50)
    even = [np.full((4, 4), 0.25) for _ in TREE.parent]
    df = spark.createDataFrame([(0, c, [0.0] * 4) for c in range(4)], "pattern long, cell long, lik array<double>")
    found = [r.assignment for r in lk.best_assignments(df, TREE, even).collect()]
    free = len(TREE.parent) - 1
    assert len(found) == len(set(found)) == 4**free > 64


def test_chosen_assignments_against_every_tie(spark, monkeypatch):
    monkeypatch.setattr(lk, "ROWS", 50)
    even = [np.full((4, 4), 0.25) for _ in TREE.parent]
    lik = np.log(np.random.default_rng(5).choice([0.2, 0.4], (3, 4, 4)))
    df = spark.createDataFrame([(p, c, lik[p, c].tolist()) for p in range(3) for c in range(4)], "pattern long, cell long, lik array<double>")
    found = {}
    for r in lk.chosen_assignments(df, TREE, even).collect():
        found.setdefault(r.pattern, {})[tuple(map(int, r.assignment.split(",")))] = r.node_score
    for p in range(3):
        nodes = lk.all_partials(lik[p][:, None, :], TREE, even)
        ties = lk.max_sum(lik[p][:, None, :], TREE, even)[0][1]
        scores = {a: np.logaddexp.reduce([nodes[i][0, g] for i, g in enumerate(a)]) for a in ties}
        most = max(scores.values())
        wanted = {a: s for a, s in scores.items() if s >= most - 1e-12}
        assert len(ties) > 64 and found[p].keys() == wanted.keys()
        assert all(found[p][a] == pytest.approx(s) for a, s in wanted.items())
