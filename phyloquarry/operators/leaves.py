"""Genotype likelihoods of single cells' read counts, a batch of rows at a time.

The same model as the column expressions of ``functions.distributions``, in arrays: some thirty log-gammas a cell are
too long an expression to be compiled. Equal counts in a batch are evaluated once; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.distributions import STABILISER, nucleotide_alphas


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x > 0: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8.0
    z = 1.0 / (y * y)
    series = (y - 0.5) * np.log(y) - y + 0.5 * log(2 * pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def log_beta(a: np.ndarray | float, b: np.ndarray) -> np.ndarray:
    return log_gamma(np.asarray(a, float)) + log_gamma(b) - log_gamma(a + b)


def dirichlet_multinomial(counts: np.ndarray, total: np.ndarray, alphas: list[float], alpha0: float, zero_total: float = 1.0) -> np.ndarray:
    """ln pmf of each row of ``counts``; one without reads has the value ``zero_total``."""
    out = np.full(len(total), zero_total)
    some = total > 0
    n = np.maximum(counts[some], 0.5)  # the terms of zeros are left out below
    terms = np.where(counts[some] > 0, np.log(n) + log_beta(np.array(alphas)[None], n), 0.0)
    out[some] = np.log(total[some]) + log_beta(alpha0, total[some]) - terms.sum(1)
    return out


def negative_binomial(x: np.ndarray, alleles: int, coverage: float, variance: float) -> np.ndarray:
    """ln pmf of the coverage of a cell with so many sequenced alleles."""
    k = alleles + STABILISER
    mean = k * coverage
    spread = mean + k * k * variance
    p, r = mean / spread, mean * mean / (spread - mean)
    return log_gamma(r + x) + (r + x) * log(1 - p) - log_gamma(x + 1) - log_gamma(np.array([r])) - r * log(1 / p - 1)


def modelled_alleles(most: int = 2, locus_dropout: bool = False) -> list[int]:
    """The allele counts a genotype may show: all, one lost, and both lost if whole loci can drop out."""
    return sorted({most, most - 1, *([most - 2] if locus_dropout else [])})


def components(counts: np.ndarray, total: np.ndarray, error: float, w1: float, w2: float, coverage: float, variance: float, dropout: float, single: bool) -> np.ndarray:
    """Log components (rows x genotypes x dropout states) for counts of three alternatives and the reference."""
    d = {n: dirichlet_multinomial(counts, total, a, a0) for n, (a, a0) in nucleotide_alphas(error, w1, w2).items()}
    c = {k: negative_binomial(total, k, coverage, variance) for k in modelled_alleles(2, not single)}
    stay, go = log(1 - dropout), log(dropout)
    het = np.logaddexp(d["00"], d["11"])
    two, one = [d["00"], d["01"], d["11"], d["11x"]], [d["00"], het, d["11"], d["11"]]
    out = []
    for g in range(4):
        if single:
            out.append([two[g] + c[2] + stay, one[g] + c[1] + (go - log(2) if g == 1 else go)])
        else:
            out.append([two[g] + c[2] + 2 * stay, one[g] + c[1] + stay + go + (0.0 if g == 1 else log(2)), c[0] + 2 * go])
    return np.moveaxis(np.array(out), 2, 0)


def totalled(parts: np.ndarray) -> np.ndarray:
    """The log-sum over dropout states of components (rows x genotypes x dropout states)."""
    top = parts.max(2, keepdims=True)
    return top[..., 0] + np.log(np.exp(parts - top).sum(2))


def genotype_likelihoods(reads: DataFrame, error: float, w1: float, w2: float, coverage: float, variance: float, dropout: float, single: bool = True) -> DataFrame:
    """(site, cell, lik, parts): each genotype's log likelihood, and its components by number of dropped alleles.

    ``reads`` has site, cell, r1, r2, r3, ref_reads and cov. ``single`` leaves out that both alleles drop.
    """
    columns = ["r1", "r2", "r3", "ref_reads", "cov"]

    def batchwise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            distinct, place = np.unique(frame[columns].to_numpy(float), axis=0, return_inverse=True)
            parts = components(distinct[:, :4], distinct[:, 4], error, w1, w2, coverage, variance, dropout, single)
            lik = totalled(parts).tolist()
            rows = parts.tolist()
            place = place.ravel().tolist()
            yield pd.DataFrame({"site": frame["site"], "cell": frame["cell"], "lik": [lik[i] for i in place], "parts": [rows[i] for i in place]})

    kinds = ", ".join(f"{c} {reads.schema[c].dataType.simpleString()}" for c in ("site", "cell"))
    return reads.select("site", "cell", *columns).mapInPandas(batchwise, f"{kinds}, lik array<double>, parts array<array<double>>")
