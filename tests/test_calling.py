"""Calls against all assignments of a small tree, ties and categories included."""

import itertools

import numpy as np
import pytest

from phyloquarry.operators import calling, likelihood

Q = likelihood.rate_matrix(4)
NODES = [("c0", "g0", 0.4), ("c1", "g0", 0.5), ("c2", "top", 0.8), ("g0", "top", 0.3), ("top", "root", 0.2), ("root", None, None)]


def expected(x, tree, matrices, shares):
    """(category, states) of every call by enumeration."""
    logs = [[np.log(np.maximum(m, 5e-324)) for m in ms] for ms in matrices]
    whole = [np.log(s) + likelihood.sum_product(x[:, None], tree, ms)[0, 0] for s, ms in zip(shares, matrices, strict=True)]
    found = []
    for c in [i for i, v in enumerate(whole) if v >= max(whole) - 1e-9]:
        nodes = likelihood.all_partials(x[:, None], tree, matrices[c])
        root = tree.root
        scored = []
        for inner in itertools.product(range(4), repeat=len(tree.parent) - 1):
            states = list(inner[:root]) + [0] + list(inner[root:])
            value = sum(x[i, states[i]] for i in range(tree.n_tips)) + sum(logs[c][i][states[p], states[i]] for i, p in enumerate(tree.parent) if p >= 0)
            scored.append((value, states))
        best = max(v for v, _ in scored)
        for v, states in scored:
            if v >= best - 1e-9:
                own = np.array([nodes[i][0, s] for i, s in enumerate(states)])
                found.append((np.logaddexp.reduce(own), c, states))
    most = max(f[0] for f in found)
    return max(whole) if len(whole) == 1 else np.logaddexp.reduce(whole), [(c, s) for v, c, s in found if v >= most - 1e-9]


def test_calls(spark):
    tree = calling.tree_of(NODES, ["c0", "c1", "c2"])
    rates, shares = [0.5, 1.5], [0.5, 0.5]
    matrices = [[likelihood.transition(Q, r * t) for t in tree.length] for r in rates]
    rng = np.random.default_rng(2)
    data = {p: rng.normal(-4, 3, (3, 4)) for p in range(6)}
    data[6], data[7] = np.zeros((3, 4)), np.array([[-9.0, -1, -1, -9]] * 3)
    rows = [(p, c, x[c].tolist()) for p, x in data.items() for c in range(3)]
    partials = spark.createDataFrame(rows, "pattern long, cell int, lik array<double>")
    found = calling.called(partials, tree, matrices, shares).collect()
    for p, x in data.items():
        own = sorted((r for r in found if r.pattern == p), key=lambda r: r.option)
        total, want = expected(x, tree, matrices, shares)
        assert sorted((r.category, r.states) for r in own) == sorted(want) and [r.option for r in own] == list(range(len(want)))
        for r in own:
            assert r.log_likelihood == pytest.approx(total)
            masked = np.where(np.arange(4) == 0, x, -1e4)
            assert r.constant == pytest.approx(likelihood.sum_product(masked[:, None], tree, matrices[r.category])[0, 0])
            with np.errstate(divide="ignore"):
                steps = np.concatenate([np.log(matrices[r.category][i])[r.states[tree.parent[i]]] for i in range(3)])
            assert np.allclose(r.transfer, np.maximum(steps, -745.0))
    sites = spark.createDataFrame([(10 + i, i % 8) for i in range(40)], "site long, pattern long")
    cells = sites.join(partials, "pattern").selectExpr("site", "cast(cell as long) AS cell", "cell AS place", "lik", "transform(lik, x -> array(x, x - cell + 1)) AS parts")
    told = calling.called_cells(calling.called(partials, tree, matrices, shares), sites, cells).collect()
    assert len(told) == 3 * 5 * len(found)
    for r in told:
        call = next(c for c in found if c.pattern == (r.site - 10) % 8 and c.option == r.option)
        assert r.genotype == call.states[r.cell] and r.ado == (1 if r.cell == 0 else 0)
        assert np.allclose(r.liks, data[call.pattern][r.cell] + np.array(call.transfer[4 * r.cell : 4 * r.cell + 4]))


def test_unknown_tips():
    with pytest.raises(ValueError):
        calling.tree_of(NODES, ["c0", "c9"])
