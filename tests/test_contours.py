"""Contours against a plain density on the same lattice, and against known regions."""

import numpy as np
import pytest

from phyloquarry.operators import contours


def plain_density(x, y, grid):
    """The density of samples moved to the lattice, term by term."""
    n = len(x)
    w = [v.std(ddof=1) * n ** (-1 / 6) for v in (x, y)]
    low = [v.min() - contours.MARGIN * s for v, s in zip((x, y), w, strict=True)]
    step = [(v.max() - v.min() + 2 * contours.MARGIN * s) / (grid - 1) for v, s in zip((x, y), w, strict=True)]
    nodes = [a + d * np.arange(grid) for a, d in zip(low, step, strict=True)]
    moved = [a + d * np.floor((v - a) / d + 0.5) for v, a, d in zip((x, y), low, step, strict=True)]
    k = [np.exp(-0.5 * ((g[:, None] - v[None]) / s) ** 2) / (s * np.sqrt(2 * np.pi)) for g, v, s in zip(nodes, moved, w, strict=True)]
    return k[0] @ k[1].T / n, nodes, step


def test_levels_and_areas(spark):
    rng = np.random.default_rng(3)
    data = {"one": rng.normal(0, [1, 3], (400, 2)), "two": np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(12, 1, (300, 2))])}
    rows = [(k, float(a), float(b)) for k, v in data.items() for a, b in v] + [("one", float("nan"), 1.0), ("one", None, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)]
    table = spark.createDataFrame(rows, "k string, x double, y double").repartition(4)
    levels = {r.k: r for r in contours.density_levels(table, ["k"], "x", "y", 0.9).collect()}
    found = contours.contours(table, ["k"], "x", "y", 0.9).collect()
    assert set(levels) == {"one", "two"} == {r.k for r in found}
    for k, v in data.items():
        density, nodes, step = plain_density(v[:, 0], v[:, 1], contours.GRID)
        down = np.sort(density.ravel())[::-1]
        n = int(np.argmax(np.cumsum(down) >= 0.9 * down.sum() * (1 - 1e-12))) + 1
        assert levels[k].level == pytest.approx(down[n - 1]) and levels[k].cells == n
        own = [r for r in found if r.k == k]
        # the region's area is about that of its cells, and its paths end where the density is the level
        assert sum(r.area for r in own) == pytest.approx(n * step[0] * step[1], rel=0.03)
        assert [r.path for r in own] == list(range(1, len(own) + 1)) and len(own) == (1 if k == "one" else 2)
        for r in own:
            i, j = (np.clip(np.searchsorted(g, p) - 1, 0, contours.GRID - 2) for g, p in zip(nodes, (r.xs, r.ys), strict=True))
            corners = np.stack([density[i, j], density[i + 1, j], density[i, j + 1], density[i + 1, j + 1]])
            assert (corners.min(0) <= r.level * (1 + 1e-9)).all() and (corners.max(0) >= r.level * (1 - 1e-9)).all()
    assert contours.contours(table.where("false"), ["k"], "x", "y").count() == 0


def test_paths_of_known_shapes():
    z = np.zeros((7, 7))
    z[2:5, 2:5] = 1.0
    z[3, 3] = 0.0
    rings = contours.paths(z, 0.5)
    assert sorted(round(contours.area(r), 3) for r in rings) == [-0.5, 8.5]
    assert sum(contours.area(r) for r in contours.paths(np.ones((3, 4)), 0.5)) > 6
    saddle = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert len(contours.paths(saddle, 0.4)) == 1 and len(contours.paths(saddle, 0.6)) == 2
    assert contours.paths(np.zeros((3, 3)), 1.0) == []
    for seed in range(20):
        z = np.random.default_rng(seed).random((9, 8))
        mask = contours.paths(z, 0.5)
        assert all(len(r) >= 3 for r in mask)
        inside = sum(contours.area(r) for r in contours.paths((z > 0.5) * 1.0, 0.5))
        assert 0 < inside < 90
