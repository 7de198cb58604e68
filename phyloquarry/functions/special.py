"""Special functions as column expressions: Spark has no log-gamma of its own."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Width of the steps by which exponentials are summed: exp of a step is far from overflowing.
STEP = 500.0


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0: Stirling's series at x + 8, brought back by the recurrence; about 1e-13 relative."""
    y = x + 8.0
    z = 1.0 / (y * y)
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    low = x * (x + 1.0) * (x + 2.0) * (x + 3.0)
    high = (x + 4.0) * (x + 5.0) * (x + 6.0) * (x + 7.0)
    return series - F.log(low) - F.log(high)


def log_beta(a: Column, b: Column) -> Column:
    """ln B(a, b)."""
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def log_sum_exp(values: Column) -> Column:
    """ln(sum(exp(v))) of an array column; null for an empty array."""
    most = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - most))
    return F.when(F.size(values) > 0, most + F.log(total))


def grouped_log_sum_exp(df: DataFrame, keys: list[str], value: str, name: str = "lse") -> DataFrame:
    """ln(sum(exp(value))) of each group; -inf adds nothing, NaN makes NaN, null is left out.

    Values are summed by steps of STEP, inside which exponentials are in range, so that sums are combined before any row is
    shuffled; a group then has a row for each step, not for each value.
    """
    x = F.col(value).cast("double")
    within = F.floor(F.greatest(F.least(x / STEP, F.lit(9e15)), F.lit(-9e15)))
    step = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), within)
    part = F.when(step.isNotNull(), F.exp(x - within * STEP)).when(x == float("-inf"), F.lit(0.0)).otherwise(x)
    sums = df.where(x.isNotNull()).groupBy(*keys, step.alias("_step")).agg(F.sum(part).alias("_sum"))
    top = sums.withColumn("_top", F.coalesce(F.max("_step").over(Window.partitionBy(*keys)), F.lit(0)))  # a row for each step
    scaled = F.col("_sum") * F.exp((F.coalesce("_step", F.col("_top")) - F.col("_top")) * STEP)
    total = F.sum(scaled)
    found = top.groupBy(*keys).agg(F.first("_top").alias("_top"), total.alias("_total"))
    return found.select(*keys, F.when(F.col("_total") > 0, F.col("_top") * STEP + F.log("_total")).when(F.col("_total") == 0, F.lit(float("-inf"))).otherwise(F.col("_total")).alias(name))


def geometric_mean(x: Column) -> Column:
    """The geometric mean over positive values as an aggregate; 0.0 where there is none."""
    return F.coalesce(F.exp(F.avg(F.when(x > 0, F.log(x)))), F.lit(0.0))


def finite_mean(x: Column, skip_zeros: bool = False) -> Column:
    """The mean over values that are neither NaN nor infinite."""
    fine = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.avg(F.when(fine & (x != 0) if skip_zeros else fine, x))


def phred(x: Column, rounded: bool = False) -> Column:
    """A natural-log probability as a Phred score; rounding is half up, also below zero."""
    score = x * (-10.0 / math.log(10.0))
    return F.floor(score + 0.5).cast("long") if rounded else score
