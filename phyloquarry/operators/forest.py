"""Likelihoods of many trees at once: messages climb all trees level by level, as joins and sums.

Trees are rows (tree, node, parent, length); a node's level is 0 at tips and one above its highest child elsewhere. A
row of partials belongs to a node, a rate category and a pattern. At level L every row whose parent is of that level
becomes a message to it, all others stay; one sum over (tree, category, pattern, node) then makes the partials of
the new nodes. So there are as many steps as levels, whatever the number of trees, nodes and patterns; rows are dealt once, by
pattern, or by (tree, category, pattern) where patterns are few, and only the table of branches is joined. Beside each partial climbs that of a constant
site, whose tips all have the root's genotype.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import log_sum_exp
from .consensus import climbed
from .lineage import kept

#: Levels climbed between two cuts of the lineage.
CUT = 8
#: Branches (of all trees and categories, about 200 bytes each) up to which their table is broadcast.
MOST_BROADCAST = 20_000
#: ln of the smallest positive double, which stands for an impossible transition.
LEAST = math.log(5e-324)
#: What the largest of a node's exponentials is raised by: four of them are still far below the largest double.
SHIFT = 600.0


def transitions(q: np.ndarray, times: np.ndarray) -> np.ndarray:
    """exp(q t) of each t (times x states x states), by scaling and squaring of the Taylor series."""
    times = np.asarray(times, float)
    if not len(times):
        return np.zeros((0, *q.shape))
    most = float(np.abs(q).sum(1).max() * times.max())
    halvings = max(0, math.ceil(math.log2(most)) + 4) if most > 0 else 0
    a = q[None] * (times / 2.0**halvings)[:, None, None]
    term = out = np.broadcast_to(np.eye(len(q)), a.shape)
    for k in range(1, 16):
        term = term @ a / k
        out = out + term
    for _ in range(halvings):
        out = out @ out
    return np.clip(out, 0, None)


def levels(nodes: DataFrame) -> DataFrame:
    """(tree, node, level): 0 at tips, else one above the highest child; an error if there is a cycle."""
    return climbed(nodes.select("tree", "node", "parent", F.lit(0).alias("level")), {"level": "far"})


def branches(nodes: DataFrame, q: np.ndarray, rates: list[float]) -> DataFrame:
    """(tree, node, parent, level, parent_level, label, category, log_p): ln transitions of each branch and category.

    ``nodes`` has tree, node, parent, length and label (of tips); ``rates`` are those of the categories, numbered from
    0. ``log_p`` lists the transitions row by row. A root has a parent of null and no transitions.
    """
    states = len(q)
    level = levels(nodes)
    upper = level.select("tree", F.col("node").alias("parent"), F.col("level").alias("parent_level"))
    placed = nodes.select("tree", "node", "parent", "label", F.col("length").cast("double").alias("length")).join(level, ["tree", "node"]).join(upper, ["tree", "parent"], "left")
    lengths = placed.where("parent IS NOT NULL").select("length").distinct()

    def exponentials(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for category, rate in enumerate(rates):
                p = transitions(q, frame["length"].to_numpy() * rate)
                log_p = np.where(p > 0, np.log(np.maximum(p, 5e-324)), LEAST).reshape(len(frame), states * states)
                yield pd.DataFrame({"length": frame["length"], "category": category, "log_p": list(log_p)})

    matrices = lengths.mapInPandas(exponentials, "length double, category int, log_p array<double>")
    inner = placed.where("parent IS NOT NULL").join(matrices, "length").select("tree", "node", "parent", "level", "parent_level", "label", "category", "log_p")
    category = F.explode(F.sequence(F.lit(0), F.lit(len(rates) - 1))).alias("category")
    root = placed.where("parent IS NULL").select("tree", "node", "parent", "level", "parent_level", "label", category, F.lit(None).cast("array<double>").alias("log_p"))
    return kept(inner.unionByName(root))


def _scaled(partial: list[str]) -> list[Column]:
    """exp(partial[h] - top + SHIFT) of each h as e_<name>, and top as t_<name of the first>."""
    top = F.greatest(*partial)
    return [F.exp(F.col(x) - top + SHIFT).alias(f"e_{x}") for x in partial] + [top.alias(f"t_{partial[0]}")]


def _message(partial: list[str], states: int) -> list[Column]:
    """ln sum_h P(g -> h) exp(partial[h]) for each g, from the scaled columns and the transitions m0, m1, ..

    The exponentials stand SHIFT above the largest one, so that a term underflows only where an impossible transition
    (exp(LEAST)) of the largest one outweighs it.
    """
    out = []
    for g in range(states):
        terms = [F.col(f"m{g * states + h}") * F.col(f"e_{x}") for h, x in enumerate(partial)]
        out.append(F.col(f"t_{partial[0]}") - SHIFT + F.log(sum(terms[1:], terms[0])))
    return out


def root_partials(leaves: DataFrame, branch: DataFrame, states: int = 4, constant_state: int = 0) -> DataFrame:
    """(tree, category, pattern, p0 .., c0 ..): partials at the root of each tree, and those of a constant site.

    ``leaves`` has pattern, label and the array ``lik``, the tips' genotype log likelihoods; tips without data of a
    pattern leave it open. A pattern without any data in a tree gives no row.
    """
    p, c = ([f"{x}{i}" for i in range(states)] for x in "pc")
    keys = ["tree", "category", "pattern"]
    tips = branch.where("level = 0 AND parent IS NOT NULL").select("tree", "category", "node", "label")
    at = lambda i: F.get("lik", F.lit(i))
    given = [at(i).alias(x) for i, x in enumerate(p)]
    fixed = [(at(i) if i == constant_state else F.lit(2 * LEAST)).alias(x) for i, x in enumerate(c)]
    small = branch.count() <= MOST_BROADCAST  # else both sides are shuffled, which gives the same
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = kept(leaves.select("pattern", "label", "lik")).select("pattern", "label", *given, *fixed)
    many = small and own.select("pattern").distinct().limit(4 * parts).count() == 4 * parts
    if many:  # a pattern's tips are dealt once, before trees and categories multiply them
        own = own.repartition(parts, "pattern")
    rows = own.join(F.broadcast(tips) if small else tips, "label").select(*keys, "node", *p, *c)
    if not many:
        rows = rows.repartition(parts, *keys)
    top = branch.agg(F.max("level").alias("m")).first().m or 0
    moves = [F.exp(F.get("log_p", F.lit(i))).alias(f"m{i}") for i in range(states * states)]
    up = branch.where("parent IS NOT NULL").select("tree", "category", "node", "parent", "parent_level", *moves)
    for level in range(1, top + 1):
        ahead = up.where(F.col("parent_level") == level).drop("parent_level")
        met = rows.join(F.broadcast(ahead) if small else ahead, ["tree", "category", "node"], "left")
        met = met.select("*", *_scaled(p), *_scaled(c))
        climbs = F.col("parent").isNotNull()
        moved = [F.when(climbs, m).otherwise(F.col(x)).alias(x) for x, m in zip([*p, *c], [*_message(p, states), *_message(c, states)], strict=True)]
        met = met.select(*keys, F.coalesce("parent", "node").alias("node"), *moved)
        rows = met.groupBy(*keys, "node").agg(*[F.sum(x).alias(x) for x in [*p, *c]])
        if level % CUT == 0:
            rows = kept(rows)
    roots = branch.where("parent IS NULL").select("tree", "category", "node")
    return rows.join(roots, ["tree", "category", "node"], "left_semi").drop("node")


def pattern_log_likelihoods(roots: DataFrame, shares: list[float], root_state: int = 0) -> DataFrame:
    """(tree, pattern, log_likelihood, constant): the root's genotype given, summed over categories by their shares."""
    share = F.get(F.array(*[F.lit(math.log(s)) for s in shares]), F.col("category"))
    each = roots.groupBy("tree", "pattern").agg(F.collect_list(share + F.col(f"p{root_state}")).alias("p"), F.collect_list(share + F.col(f"c{root_state}")).alias("c"))  # a value for each category
    return each.select("tree", "pattern", log_sum_exp(F.col("p")).alias("log_likelihood"), log_sum_exp(F.col("c")).alias("constant"))


def best_categories(roots: DataFrame, shares: list[float], root_state: int = 0) -> DataFrame:
    """(tree, pattern, category): the most likely category of each pattern, ties kept."""
    scored = roots.select("tree", "pattern", "category", (F.get(F.array(*[F.lit(math.log(s)) for s in shares]), F.col("category")) + F.col(f"p{root_state}")).alias("s"))
    best = scored.groupBy("tree", "pattern").agg(F.collect_list(F.struct("category", "s")).alias("all"), F.max("s").alias("top"))  # a value for each category
    return best.select("tree", "pattern", F.explode(F.filter("all", lambda x: x["s"] >= F.col("top"))).alias("x")).select("tree", "pattern", "x.category")


def tree_log_likelihoods(patterns: DataFrame, weights: DataFrame, correction: str | None = None, n_background: float = 0.0) -> DataFrame:
    """(tree, log_likelihood): patterns' log likelihoods times ``weights`` (pattern, weight) with an ascertainment correction.

    ``lewis`` takes away the log probability of a variable site for each site, ``mean`` and ``geometric`` add the mean log
    probability of a constant one for each of ``n_background`` sites. Without ``correction`` there is none.
    """
    w, c = F.col("weight"), F.col("constant")
    met = patterns.join(weights, "pattern")
    total = F.sum(w * F.col("log_likelihood"))
    if correction is None:
        return met.groupBy("tree").agg(total.alias("log_likelihood"))
    if correction == "lewis":
        return met.groupBy("tree").agg((total - F.sum(w * F.log1p(-F.exp(c)))).alias("log_likelihood"))
    if correction == "geometric":
        return met.groupBy("tree").agg((total + F.sum(w * c) * n_background / F.sum(w)).alias("log_likelihood"))
    if correction != "mean":
        raise ValueError(f"No such correction: {correction}")
    most = met.groupBy("tree").agg(F.max("constant").alias("most"))
    each = met.join(most, "tree").groupBy("tree", "most").agg(total.alias("total"), F.sum(w * F.exp(c - F.col("most"))).alias("s"), F.sum(w).alias("loci"))
    return each.select("tree", (F.col("total") + (F.col("most") + F.log("s") - F.log("loci")) * n_background).alias("log_likelihood"))
