"""Summaries of posterior samples: burn-in, point estimates, intervals, modes and choices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ALL, PLACE, medians, met, numbered, with_key_values

RANKED = "_rank"
#: Values in a block of ``kde_mode``, blocks of a bin that meet others together, and bandwidths in a bin; a kernel is 0 as
#: a double beyond 39 bandwidths.
BLOCK, SPAN, BIN, REACH = 256, 64, 4, 39


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], name: str = RANKED) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def after_burn_in(trace: DataFrame, share: float, keys: list[str], order: str = "sample", up: bool = False) -> DataFrame:
    """Rows after the first ``share`` of each key's samples; the number skipped is rounded down, or up if asked."""
    skip = F.lit(share) * F.col(ALL)
    rows = numbered(trace, keys, [order])
    return rows.where(F.col(PLACE) > (F.ceil(skip) if up else F.floor(skip))).select(*trace.columns)


def estimates(trace: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, n, mean, median) over finite values."""
    return medians(trace, keys, value)


def short_estimates(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, mean_x, median_x for each of ``values``) over finite values, null where there are none.

    For keys of few rows, such as the cells of a site: a key's values meet in one row. ``estimates`` has keys of any size.
    """
    finite = [F.when(~F.isnan(F.col(v).cast("double")) & (F.abs(F.col(v).cast("double")) < float("inf")), F.col(v).cast("double")) for v in values]
    aggregates = [f(x).alias(f"{name}_{v}") for name, f in (("mean", F.avg), ("_all", F.collect_list)) for v, x in zip(values, finite, strict=True)]
    ordered = rows.groupBy(*keys).agg(*aggregates).select(*keys, *[f"mean_{v}" for v in values], *[F.sort_array(f"_all_{v}").alias(f"_all_{v}") for v in values])
    middle = lambda v, shift: F.get(f"_all_{v}", F.floor((F.size(f"_all_{v}") - 1 + shift) / 2).cast("int"))
    medians = [((middle(v, 0) + middle(v, 1)) / 2).alias(f"median_{v}") for v in values]
    return ordered.select(*keys, *[x for v, m in zip(values, medians, strict=True) for x in (f"mean_{v}", m)])


def value_range(trace: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return trace.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def hpd(trace: DataFrame, keys: list[str], mass: float = 0.95, value: str = "value", tie: str = "sample") -> DataFrame:
    """(keys, hpd_low, hpd_high): the narrowest run of round(mass n) sorted values; the first of equals."""
    rows = numbered(trace.select(*keys, value, *[c for c in [tie] if c not in (*keys, value)]), keys, [value, tie])
    rows = rows.withColumn("_k", F.greatest(F.floor(F.lit(mass) * F.col(ALL) + 0.5), F.lit(1)))
    ends = rows.select(*keys, (F.col(RANKED) - F.col("_k") + 1).alias(RANKED), F.col(value).alias("_high"))
    runs = met(rows.select(*keys, RANKED, F.col(value).alias("_low")), ends, [*keys, RANKED])
    best = F.min(F.struct((F.col("_high") - F.col("_low")).alias("width"), RANKED, "_low", "_high")).alias("b")
    return runs.groupBy(*keys).agg(best).select(*keys, F.col("b._low").alias("hpd_low"), F.col("b._high").alias("hpd_high"))


def frequencies(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, share) of discrete values."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def discrete_mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mode, mode_share): the most frequent values joined by +, and their share together."""
    first = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("n")))
    top = frequencies(df, keys, value).withColumn(RANKED, first).where(f"{RANKED} = 1")
    return top.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.col(value).cast("string"))), "+").alias("mode"), F.sum("share").alias("mode_share"))


def frequency_set(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value_set, share_set): values in order with their shares, as text."""
    each = frequencies(df, keys, value)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(value).cast("string").alias("v"), F.col("share").alias("s"))))
    listed = each.groupBy(*keys).agg(pairs.alias("p"))
    text = lambda f: F.array_join(F.transform("p", f), ",")
    return listed.select(*keys, text(lambda x: x["v"]).alias("value_set"), text(lambda x: F.format_string("%.4f", x["s"])).alias("share_set"))


def best_with_ties(df: DataFrame, keys: list[str], score: str, largest: bool = True) -> DataFrame:
    """All rows that share the best score of their key; the score is found by an aggregate, so no key meets in one task."""
    best = df.groupBy(*keys).agg((F.max if largest else F.min)(score).alias("_best"))
    return with_key_values(df, best, keys).where(F.col(score).eqNullSafe(F.col("_best"))).select(*df.columns)


def best_configurations(runs: DataFrame, keys: list[str], config: str, posterior: str) -> DataFrame:
    """(keys, config, posterior): the configurations whose largest log posterior is the key's largest, ties kept."""
    each = runs.groupBy(*keys, config).agg(F.max(posterior).alias(posterior))
    return best_with_ties(each, keys, posterior)


def first_seen(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, seen): the distinct values of each key in the order of their first rows, equal ones by value."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias("_first"))
    listed = F.array_sort(F.collect_list(F.struct("_first", F.col(value).alias("v"))))
    return first.groupBy(*keys).agg(F.transform(listed, lambda x: x["v"]).alias("seen"))


def kde_mode(trace: DataFrame, keys: list[str], value: str = "value", order: str = "sample") -> DataFrame:
    """(keys, mode): the sample with the highest Gaussian kernel density, the first of equals (to 13 digits).

    The bandwidth is Silverman's rule, 1.06 s n^-1/5. Equal values are counted once and dealt to blocks of about
    BLOCK values within bins; pairs of blocks are rows, so a key is as many tasks as there are, and only pairs
    whose kernels are 0 are left out.
    """
    x = F.col(value).cast("double")
    groups = trace.groupBy(*keys).agg(F.lit(True).alias("_any")).select(F.struct(*keys).alias("_key"))
    finite = trace.select(F.struct(*keys).alias("_key"), x.alias("_x"), F.col(order).alias("_order")).where(~F.isnan("_x") & (F.abs("_x") < float("inf")))
    width = 1.06 * F.coalesce(F.stddev_samp("_x"), F.lit(0.0)) * F.pow(F.count(F.lit(1)), F.lit(-0.2))
    stats = finite.groupBy("_key").agg(F.min("_x").alias("_low"), width.alias("_width"))
    same_key = lambda a, b: a["_key"].eqNullSafe(b["_key"])
    counted = finite.groupBy("_key", "_x").agg(F.count(F.lit(1)).cast("double").alias("_n"), F.min("_order").alias("_first"))
    of = stats.withColumnRenamed("_key", "_of")
    placed = counted.join(of, counted["_key"].eqNullSafe(of["_of"])).drop("_of")
    bin_of = F.when(F.col("_width") > 0, F.floor((F.col("_x") - F.col("_low")) / (BIN * F.col("_width")))).otherwise(F.lit(0))
    placed = placed.withColumn("_bin", bin_of)
    full = placed.groupBy("_key", "_bin").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks")).select(F.col("_key").alias("_of"), F.col("_bin").alias("_at"), "_blocks")
    salted = placed.join(full, placed["_key"].eqNullSafe(full["_of"]) & (placed["_bin"] == full["_at"])).withColumn("_salt", F.pmod(F.xxhash64("_x"), "_blocks"))
    values = F.array_sort(F.collect_list(F.struct("_x", "_n", "_first")))
    blocks = salted.groupBy("_key", "_bin", "_salt", "_width").agg(values.alias("_v"))
    near = REACH // BIN + 1
    left = blocks.select("_key", "_width", F.explode(F.sequence(F.col("_bin") - near, F.col("_bin") + near)).alias("_bin"), F.col("_v")["_x"].alias("_a"), F.col("_v")["_first"].alias("_firsts"))
    spans = full.select("_of", "_at", F.explode(F.sequence(F.lit(0), F.floor((F.col("_blocks") - 1) / SPAN))).alias("_span"))
    left = left.join(spans, left["_key"].eqNullSafe(spans["_of"]) & (left["_bin"] == spans["_at"])).drop("_of", "_at")
    right = blocks.select(F.col("_key").alias("_of"), F.col("_bin").alias("_at"), F.floor(F.col("_salt") / SPAN).alias("_part"), F.col("_v")["_x"].alias("_b"), F.col("_v")["_n"].alias("_m"))
    pairs = left.join(right, left["_key"].eqNullSafe(right["_of"]) & (left["_bin"] == right["_at"]) & (left["_span"] == right["_part"])).select("_key", "_width", "_a", "_firsts", "_b", "_m")

    def partial(frames):
        for frame in frames:
            found = [np.exp(-0.5 * ((a[:, None] - b[None]) / w) ** 2) @ m if w > 0 else np.ones(len(a)) for a, b, m, w in zip(frame["_a"], frame["_b"], frame["_m"], frame["_width"], strict=True)]
            yield frame[["_key", "_a", "_firsts"]].assign(_d=[d.tolist() for d in found])

    kinds = f"_key {groups.schema['_key'].dataType.simpleString()}, _a array<double>, _firsts array<{finite.schema['_order'].dataType.simpleString()}>, _d array<double>"
    parts = pairs.mapInPandas(partial, kinds).select("_key", F.explode(F.arrays_zip("_a", "_firsts", "_d")).alias("_p"))
    dense = parts.groupBy("_key", F.col("_p._a").alias("_x"), F.col("_p._firsts").alias("_first")).agg(F.sum("_p._d").alias("_d"))
    top = dense.groupBy("_key").agg(F.max("_d").alias("_top")).withColumnRenamed("_key", "_of")
    tied = dense.join(top, dense["_key"].eqNullSafe(top["_of"])).where(F.col("_d") >= F.col("_top") * (1 - 1e-13))
    best = tied.groupBy("_key").agg(F.min_by("_x", F.struct("_first", "_x")).alias("mode"))
    return groups.join(best, same_key(groups, best), "left").select(*[groups["_key"][k].alias(k) for k in keys], "mode")


def hpd_area_2d(trace: DataFrame, keys: list[str], x: str, y: str, mass: float = 0.95, bins: int = 40) -> DataFrame:
    """(keys, level, cells): the density level of a ``bins`` x ``bins`` grid whose cells above it hold ``mass``."""
    edges = trace.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{a}") for a, c in (("x", x), ("y", y)) for n, f in (("low", F.min), ("high", F.max))])
    trace = met(trace.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")), edges, keys)
    cell = lambda a: F.least(F.floor((F.col(f"_{a}") - F.col(f"_low_{a}")) / F.greatest(F.col(f"_high_{a}") - F.col(f"_low_{a}"), F.lit(1e-300)) * bins), F.lit(bins - 1))
    edge = Window.partitionBy(*keys)  # over the grid, bins x bins rows a key
    grid = trace.select(*keys, cell("x").alias("i"), cell("y").alias("j")).groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("n"))
    down = edge.orderBy(F.desc("n"), "i", "j")
    ordered = grid.withColumn("held", F.sum("n").over(down) - F.col("n")).withColumn("all", F.sum("n").over(edge))
    return ordered.where(F.col("held") < mass * F.col("all")).groupBy(*keys).agg(F.min("n").alias("level"), F.count(F.lit(1)).alias("cells"))
