"""Kernel density modes against the full sum."""

import random

import numpy as np
import pytest

from phyloquarry.operators import summaries


def brute(values):
    x = np.array([v for _, v in sorted(values) if v is not None and np.isfinite(v)])
    if not len(x):
        return None
    width = 1.06 * x.std(ddof=1) * len(x) ** -0.2 if len(x) > 1 else 0.0
    if width == 0:
        return x[0]
    density = np.exp(-0.5 * ((x[:, None] - x[None]) / width) ** 2).sum(1)
    return x[np.flatnonzero(density >= density.max() * (1 - 1e-13))[0]]


@pytest.mark.parametrize("block", [3, 256])
def test_kde_mode_is_the_full_sum(spark, monkeypatch, block):
    monkeypatch.setattr(summaries, "BLOCK", block)
    monkeypatch.setattr(summaries, "SPAN", 2)
    draw = random.Random(5)
    groups = {
        "wide": [draw.gauss(0, 1) for _ in range(700)] + [1e4],
        "rounded": [round(draw.gauss(3, 2), 1) for _ in range(500)],
        "tied": [1.0, 0.0, 0.0, 1.0],
        "far": [0.0] * 40 + [1e9, 1e9 + 1],
        "same": [2.5] * 5,
        "one": [7.0],
        "none": [None, float("nan")],
        None: [4.0, 4.0, 9.0, float("inf")],
    }
    rows = [(k, i, v) for k, g in groups.items() for i, v in enumerate(g)]
    draw.shuffle(rows)
    trace = spark.createDataFrame(rows, "var string, sample long, value double").repartition(3)
    found = summaries.kde_mode(trace, ["var"])
    assert {r.var: r.mode for r in found.collect()} == {k: brute(list(enumerate(g))) for k, g in groups.items()}
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()  # no task holds a whole key
