import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phyloquarry.functions import distributions, special


def test_log_gamma(spark):
    xs = [0.001, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 100.25, 1e4, 1e8]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.log_gamma(F.col("x")).alias("y"))
    for r in df.collect():
        assert r.y == pytest.approx(math.lgamma(r.x), rel=1e-11, abs=1e-11)


def test_log_sum_exp_of_arrays(spark):
    rows = [([1.0, 2.0, 3.0],), ([-1000.0, -1000.0],), ([],)]
    found = [r.y for r in spark.createDataFrame(rows, "x array<double>").select(special.log_sum_exp(F.col("x")).alias("y")).collect()]
    assert found[0] == pytest.approx(math.log(sum(map(math.exp, (1, 2, 3)))))
    assert found[1] == pytest.approx(-1000 + math.log(2))
    assert found[2] is None


def test_phred_rounds_half_up_below_zero(spark):
    x = 2.5 * math.log(10) / 10
    r = spark.range(1).select(special.phred(F.lit(x), True).alias("a"), special.phred(F.lit(-x), True).alias("b")).first()
    assert (r.a, r.b) == (-2, 3)


def test_dirichlet_multinomial(spark):
    counts, alphas = [3, 0, 1, 6], [0.4, 0.3, 0.2, 9.1]
    row = spark.range(1).select(
        distributions.dirichlet_multinomial([F.lit(float(c)) for c in counts], F.lit(10.0), [F.lit(a) for a in alphas], F.lit(10.0)).alias("x"),
        distributions.dirichlet_multinomial([F.lit(0.0)] * 4, F.lit(0.0), [F.lit(a) for a in alphas], F.lit(10.0)).alias("none"),
    ).first()
    lb = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    want = math.log(10) + lb(10, 10) - sum(math.log(c) + lb(a, c) for c, a in zip(counts, alphas, strict=True) if c)
    assert row.x == pytest.approx(want)
    assert row.none == 1.0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=8), st.floats(-100, 100))
def test_log_sum_exp_shift(values, shift):
    f = lambda v: max(v) + math.log(sum(math.exp(x - max(v)) for x in v))
    assert f([x + shift for x in values]) == pytest.approx(f(values) + shift, abs=1e-9)


def test_error_rate_bound_and_coverage_off(spark):
    for error in (-0.1, 0.76):
        with pytest.raises(ValueError, match="Error rate"):
            distributions.nucleotide_alphas(error, 1.0, 1.0)
    d, zero = {k: F.lit(-1.0) for k in ("00", "11", "11x", "01")}, {k: F.lit(0.0) for k in range(3)}
    parts = [F.array(*x) for c in (None, zero) for x in distributions.mixture(d, c, 0.1).values()]
    row = list(spark.range(1).select(*parts).first())
    assert row[:4] == row[4:]
