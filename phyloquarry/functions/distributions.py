"""Log probabilities of read counts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import log_beta, log_gamma

#: Keeps variances above means where no allele was sequenced.
STABILISER = 1e-6


def negative_binomial(x: Column, p: Column, r: Column) -> Column:
    """ln pmf at ``x`` with p = mean / variance and size ``r``."""
    return log_gamma(r + x) + (r + x) * F.log(1 - p) - log_gamma(x + 1) - log_gamma(r) - r * F.log(1 / p - 1)


def dirichlet_multinomial(counts: list[Column], total: Column, alphas: list[Column], alpha0: Column, zero_total: float | None = 1.0) -> Column:
    """ln pmf of ``counts`` that sum to ``total``.

    An observation without reads has the value ``zero_total``: 1.0 as in the model whose results are matched,
    None for the exact 0.0.
    """
    log_norm = F.log(total) + log_beta(alpha0, total)
    terms = [F.when(n > 0, F.log(n) + log_beta(a, n)).otherwise(0.0) for n, a in zip(counts, alphas, strict=True)]
    return F.when(total == 0, F.lit(0.0 if zero_total is None else zero_total)).otherwise(log_norm - sum(terms[1:], terms[0]))


def beta_binomial(x: Column, n: Column, a: Column, b: Column) -> Column:
    """ln pmf of ``x`` successes in ``n``."""
    choose = log_gamma(n + 1) - log_gamma(x + 1) - log_gamma(n - x + 1)
    return choose + log_beta(x + a, n - x + b) - log_beta(a, b)


def coverage_moments(alleles: Column, coverage: Column, variance: Column, size_factor: Column) -> tuple[Column, Column]:
    """(p, r) of the coverage of a cell with so many sequenced alleles."""
    k = alleles + STABILISER
    mean = k * coverage * size_factor
    spread = mean + size_factor * size_factor * k * k * variance
    return mean / spread, mean * mean / (spread - mean)


def nucleotide_alphas(error: float, w1: float, w2: float) -> dict[str, tuple[list[float], float]]:
    """Dirichlet parameters (three alternatives, reference) and their sum for the four situations.

    The error rate lies between 0 and 0.75, where all nucleotides are alike.
    """
    if not 0 <= error <= 0.75:
        raise ValueError(f"Error rate {error} is not between 0 and 0.75")
    e3, most, half = error / 3, 1 - error, 0.5 - error / 3
    return {
        "00": ([e3 * w1, e3 * w1, e3 * w1, most * w1], w1),
        "11": ([most * w1, e3 * w1, e3 * w1, e3 * w1], w1),
        "11x": ([half * w2, half * w2, e3 * w2, e3 * w2], w2),
        "01": ([half * w2, e3 * w2, e3 * w2, half * w2], w2),
    }


def nucleotide_log_likelihoods(reads: list[Column], coverage: Column, error: float, w1: float, w2: float) -> dict[str, Column]:
    """ln likelihood of (alternative reads in order, reference reads) in each situation."""
    return {name: dirichlet_multinomial(reads, coverage, [F.lit(a) for a in alphas], F.lit(total)) for name, (alphas, total) in nucleotide_alphas(error, w1, w2).items()}


def mixture(d: dict[str, Column], c: dict[int, Column] | None, dropout: float, single: bool = True) -> dict[str, list[Column]]:
    """Log components of each genotype's likelihood, in the order no, single and locus dropout.

    ``d`` holds nucleotide and ``c`` coverage log likelihoods by number of alleles; a component that cannot occur
    is left out. Without ``c`` the coverage plays no part.
    """
    from math import log

    c = c or {k: F.lit(0.0) for k in range(3)}

    stay, go = log(1 - dropout), log(dropout)
    pair = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    het = pair(d["00"], d["11"])
    one = {"0/0": d["00"], "0/1": het, "1/1": d["11"], "1/2": d["11"]}
    two = {"0/0": d["00"], "0/1": d["01"], "1/1": d["11"], "1/2": d["11x"]}
    out = {}
    for g in ("0/0", "0/1", "1/1", "1/2"):
        if single:
            out[g] = [two[g] + c[2] + stay, one[g] + c[1] + (go - log(2) if g == "0/1" else go)]
        else:
            half = 0.0 if g == "0/1" else log(2)
            out[g] = [two[g] + c[2] + 2 * stay, one[g] + c[1] + stay + go + half, c[0] + 2 * go]
    return out
