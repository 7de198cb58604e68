"""Contours of two-dimensional densities: the regions that hold a given share of the samples.

Samples are counted on a grid first, by a partial aggregate, so that a key with any number of them is GRID squared rows
at most. The Gaussian kernel is separable: the density is the counts times a kernel along x, times one along y. The level
is that above which the grid's cells hold the mass, and its contours are followed through the squares between cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import with_key_values

GRID = 48
#: Bandwidths that the grid reaches beyond the samples.
MARGIN = 3.0
BANDS = "_n long, _wx double, _wy double, _x0 double, _dx double, _y0 double, _dy double"


def gridded(samples: DataFrame, keys: list[str], x: str, y: str, grid: int = GRID) -> DataFrame:
    """(keys, _n, _wx, _wy, _x0, _dx, _y0, _dy, i, j, n): the number of samples at each node of a ``grid`` by ``grid`` lattice.

    The bandwidth of an axis is Scott's rule, s n^-1/6; the lattice spans the samples and MARGIN bandwidths more.
    Samples that are null, NaN or infinite in one of the two are left out, and keys that don't vary in both.
    """
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    own = samples.where(fine(x) & fine(y)).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rule = lambda c: F.stddev_samp(c) * F.pow(F.count(F.lit(1)), F.lit(-1 / 6))
    ends = [f(f"_{a}").alias(f"_{n}{a}") for a in "xy" for n, f in (("low", F.min), ("high", F.max))]
    spans = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), rule("_x").alias("_wx"), rule("_y").alias("_wy"), *ends).where("_wx > 0 AND _wy > 0")
    sides = []
    for a in "xy":
        low, high, wide = F.col(f"_low{a}"), F.col(f"_high{a}"), F.col(f"_w{a}")
        sides += [(low - MARGIN * wide).alias(f"_{a}0"), ((high - low + 2 * MARGIN * wide) / (grid - 1)).alias(f"_d{a}")]
    spans = spans.select(*keys, "_n", "_wx", "_wy", *sides)
    names = [c for c in spans.columns if c not in keys]
    place = lambda a: F.floor((F.col(f"_{a}") - F.col(f"_{a}0")) / F.col(f"_d{a}") + 0.5).cast("int")
    placed = with_key_values(own, spans, keys).select(*keys, *names, place("x").alias("i"), place("y").alias("j"))
    return placed.groupBy(*keys, *names, "i", "j").agg(F.count(F.lit(1)).alias("n"))


def lattice_density(frame: pd.DataFrame, grid: int) -> np.ndarray:
    """The density at each node, from the rows of one key of ``gridded``."""
    r = frame.iloc[0]
    counts = np.zeros((grid, grid))
    np.add.at(counts, (frame["i"].to_numpy(), frame["j"].to_numpy()), frame["n"].to_numpy())
    steps = np.arange(grid)[:, None] - np.arange(grid)[None]
    kernel = lambda d, w: np.exp(-0.5 * (steps * d / w) ** 2) / (w * np.sqrt(2 * np.pi))
    return kernel(r["_dx"], r["_wx"]) @ counts @ kernel(r["_dy"], r["_wy"]).T / r["_n"]


def mass_level(density: np.ndarray, mass: float) -> tuple[float, int]:
    """The density of the last cell that is needed for ``mass``, taken from the densest down, and the number of cells."""
    down = np.sort(density.ravel())[::-1]
    held = np.cumsum(down)
    n = int(np.searchsorted(held, mass * held[-1] * (1 - 1e-12))) + 1
    return float(down[n - 1]), n


def paths(density: np.ndarray, level: float) -> list[np.ndarray]:
    """Closed polygons (points x 2, in node units) around the cells above ``level``, by marching squares.

    The high side is to the left of a path, so that a region's outline has a positive area and a hole's a negative one. In a
    saddle the mean of the four corners says which of them are joined.
    """
    z = np.full((density.shape[0] + 2, density.shape[1] + 2), min(float(density.min()), level) - abs(level) - 1.0)
    z[1:-1, 1:-1] = density
    high = z >= level
    code = high[:-1, :-1] * 1 + high[1:, :-1] * 2 + high[1:, 1:] * 4 + high[:-1, 1:] * 8
    following: dict[tuple, list[tuple]] = {}

    def crossing(i: int, j: int, side: int) -> tuple:
        """The edge of a square: 0 below, 1 right, 2 above, 3 left, as (first node, axis)."""
        return ((i, j, 0), (i + 1, j, 1), (i, j + 1, 0), (i, j, 1))[side]

    # sides in which a path enters and leaves a square, high corners to its left
    segments = {1: [(3, 0)], 2: [(0, 1)], 3: [(3, 1)], 4: [(1, 2)], 6: [(0, 2)], 7: [(3, 2)], 8: [(2, 3)], 9: [(2, 0)], 11: [(2, 1)], 12: [(1, 3)], 13: [(1, 0)], 14: [(0, 3)]}
    for i, j in zip(*np.nonzero((code > 0) & (code < 15)), strict=True):
        c = int(code[i, j])
        if c in (5, 10):
            joined = z[i : i + 2, j : j + 2].mean() >= level
            own = ([(1, 0), (3, 2)] if joined else [(3, 0), (1, 2)]) if c == 5 else ([(0, 3), (2, 1)] if joined else [(0, 1), (2, 3)])
        else:
            own = segments[c]
        for enters, leaves in own:
            following.setdefault(crossing(i, j, leaves), []).append(crossing(i, j, enters))

    def point(edge: tuple) -> tuple[float, float]:
        i, j, axis = edge
        a, b = z[i, j], z[i + (axis == 0), j + (axis == 1)]
        t = min(max((level - a) / (b - a), 0.0), 1.0)
        return i - 1 + t * (axis == 0), j - 1 + t * (axis == 1)

    out = []
    while following:
        start = next(iter(following))
        ring, at = [], start
        while True:
            ring.append(point(at))
            after = following[at].pop()
            if not following[at]:
                del following[at]
            at = after
            if at == start:
                break
        out.append(np.array(ring))
    return out


def area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def density_levels(samples: DataFrame, keys: list[str], x: str, y: str, mass: float = 0.95, grid: int = GRID) -> DataFrame:
    """(keys, level, cells): the density above which cells hold ``mass``, and how many they are."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        level, n = mass_level(lattice_density(frame, grid), mass)
        return pd.DataFrame({**{k: frame[k].iloc[:1].to_numpy() for k in keys}, "level": [level], "cells": [n]})

    return gridded(samples, keys, x, y, grid).groupBy(*keys).applyInPandas(one, f"{_kinds(samples, keys)}, level double, cells int")


def contours(samples: DataFrame, keys: list[str], x: str, y: str, mass: float = 0.95, grid: int = GRID) -> DataFrame:
    """(keys, level, path, xs, ys, area): the closed contours of the region of highest density that holds ``mass``.

    Paths are numbered from 1, the largest first; a hole has a negative area. A region of several paths is not one piece.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.iloc[0]
        density = lattice_density(frame, grid)
        level, _ = mass_level(density, mass)
        rings = [np.column_stack([r["_x0"] + p[:, 0] * r["_dx"], r["_y0"] + p[:, 1] * r["_dy"]]) for p in paths(density, level)]
        rings.sort(key=lambda p: -abs(area(p)))
        out = [{"level": level, "path": i, "xs": p[:, 0].tolist(), "ys": p[:, 1].tolist(), "area": area(p)} for i, p in enumerate(rings, 1)]
        return pd.DataFrame(out).assign(**{k: frame[k].iloc[0] for k in keys})

    return gridded(samples, keys, x, y, grid).groupBy(*keys).applyInPandas(one, f"{_kinds(samples, keys)}, level double, path int, xs array<double>, ys array<double>, area double")


def _kinds(samples: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)
