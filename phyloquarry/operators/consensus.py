"""Annotated consensus trees from clade fingerprints.

A clade is known by 128 bits: the exclusive-or of its tips' hashes, taken up all trees at once by pointer doubling, so
that a ladder of n levels costs 2 log n joins of n rows and no text or list of tips is ever made. The tree whose clades
are the most credible is annotated with what all sampled trees say of its clades.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import trees
from .lineage import kept
from .ranks import medians
from .summaries import hpd


def climbed(nodes: DataFrame, totals: dict[str, str]) -> DataFrame:
    """(tree, node, totals): columns of ``nodes`` taken over a node and all below it; an error if there is a cycle.

    A total is ``xor``, ``sum`` or ``far``: the largest of values plus the steps to where they stand. In round i a node
    adds what its descendants at 2**i steps hold, which is all up to 2**i steps below them.
    """
    state = kept(nodes.select("tree", "node", F.col("parent").alias("above"), *totals))
    most = state.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    steps = 1
    while state.where("above IS NOT NULL").take(1):
        if steps > most:
            raise ValueError("a tree has a cycle")
        gathered = {"xor": F.bit_xor, "sum": F.sum, "far": F.max}
        below = state.where("above IS NOT NULL").groupBy("tree", F.col("above").alias("node")).agg(*[gathered[how](c).alias(f"_{c}") for c, how in totals.items()])
        ahead = state.select("tree", F.col("node").alias("above"), F.col("above").alias("_next"))

        def joined(c: str, how: str, steps: int = steps) -> Column:
            more = F.col(f"_{c}")
            if how == "far":
                return F.greatest(F.col(c), more + steps).alias(c)
            added = F.coalesce(more, F.lit(0))
            return (F.col(c).bitwiseXOR(added) if how == "xor" else F.col(c) + added).alias(c)

        met = state.join(below, ["tree", "node"], "left").join(ahead, ["tree", "above"], "left")
        state = kept(met.select("tree", "node", F.col("_next").alias("above"), *[joined(c, how) for c, how in totals.items()]))
        steps *= 2
    return state.drop("above")


def fingerprints(nodes: DataFrame, name: str = "node") -> DataFrame:
    """(tree, node, clade, size): the fingerprint of the tips below each node, by their column ``name``, and their number."""
    inner = nodes.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node"), F.lit(True).alias("inner")).distinct()
    tip = F.col("inner").isNull()
    marks = [F.when(tip, F.xxhash64(F.lit(seed), F.col("name"))).otherwise(F.lit(0)).alias(c) for seed, c in ((1, "a"), (2, "b"))]
    start = nodes.select("tree", "node", "parent", F.col(name).alias("name")).join(inner, ["tree", "node"], "left")
    found = climbed(start.select("tree", "node", "parent", *marks, tip.cast("long").alias("size")), {"a": "xor", "b": "xor", "size": "sum"})
    return found.select("tree", "node", F.struct("a", "b").alias("clade"), "size")


def with_lengths(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``length``, the height above them to their parent; null at a root."""
    tops = nodes.select("tree", F.col("node").alias("parent"), F.col("height").alias("_top"))
    return nodes.drop("length").join(tops, ["tree", "parent"], "left").withColumn("length", F.col("_top") - F.col("height")).drop("_top")


def placed(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """``prints`` with ``place``: nodes of one tree that hold the same tips, as a trunk and its child do, from below."""
    up = Window.partitionBy("tree", "clade").orderBy("height", "node")  # nodes with one child only
    return prints.join(nodes.select("tree", "node", "height"), ["tree", "node"]).withColumn("place", F.row_number().over(up)).drop("height")


def clade_values(target: DataFrame, prints: DataFrame, nodes: DataFrame, attributes: list[str]) -> DataFrame:
    """(node, name, tree, value): what each sampled tree has for the clades of ``target`` (clade, place, node)."""
    wanted = target.select("clade", "place", F.col("node").alias("target"))
    met = prints.select("tree", "node", "clade", "place").join(wanted, ["clade", "place"]).join(nodes.select("tree", "node", *attributes), ["tree", "node"])
    pairs = F.array(*[F.struct(F.lit(a).alias("name"), F.col(a).cast("double").alias("value")) for a in attributes])
    long = met.select(F.col("target").alias("node"), "tree", F.explode(pairs).alias("p"))
    return long.select("node", "tree", "p.name", "p.value").where("value IS NOT NULL")


def summarised(values: DataFrame, mass: float = 0.95) -> DataFrame:
    """(node, name, n, mean, median, low, high, hpd_low, hpd_high); but for the mean null where nothing varies."""
    keys = ["node", "name"]
    each = medians(values, keys, "value").join(values.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high")), keys)
    varying = each.where("low < high").select(*keys)
    ends = hpd(values.join(varying, keys, "left_semi"), keys, mass, tie="tree")
    met = each.join(ends, keys, "left")
    varies = F.col("low") < F.col("high")
    return met.select(*keys, "n", "mean", *[F.when(varies, F.col(c)).alias(c) for c in ("median", "low", "high")], "hpd_low", "hpd_high")


def notes(summaries: DataFrame, credibility: DataFrame, mass: float = 0.95) -> DataFrame:
    """(node, key, value) as tree labels have them: the mean under an attribute's name, median, interval and range, and ``posterior``.

    ``credibility`` has node and credibility.
    """
    text = lambda c: F.col(c).cast("string")
    pair = lambda a, b: F.concat(F.lit("{"), text(a), F.lit(","), text(b), F.lit("}"))
    kinds = [("", text("mean")), ("_median", text("median")), (f"_{mass * 100:g}%_HPD", pair("hpd_low", "hpd_high")), ("_range", pair("low", "high"))]
    each = F.array(*[F.struct(F.concat("name", F.lit(ending)).alias("key"), value.alias("value")) for ending, value in kinds])
    own = summaries.select("node", F.explode(each).alias("n")).select("node", "n.key", "n.value").where("value IS NOT NULL")
    return own.unionByName(credibility.select("node", F.lit("posterior").alias("key"), text("credibility").alias("value")))


def annotated_tree(nodes: DataFrame, attributes: list[str], heights: str = "keep", mass: float = 0.95, name: str = "node", limit: float = 0.0) -> DataFrame:
    """The best tree's (tree, node, parent, label, height, length, meta): the one of the most credible clades, annotated.

    ``nodes`` has tree, node, parent, height and the ``attributes``; of these ``length`` is the height to the parent. The
    tips' ``name`` tells which are alike. ``heights`` says whether a node keeps its height or shows the ``mean`` or
    ``median`` of the samples. Clades that a tree holds twice, at a trunk, are matched from below. A clade whose
    credibility is below ``limit`` is given that and nothing else.
    """
    full = kept(with_lengths(nodes))
    n_trees = full.select("tree").distinct().count()
    if not n_trees:
        raise ValueError("No tree to annotate")
    prints = kept(placed(fingerprints(full, name), full))
    credibility = kept(trees.clade_credibility(prints, n_trees))
    scores = trees.tree_scores(prints, credibility).withColumn("log_cred", F.round("log_cred", 9))
    best = trees.best_tree(scores).first().tree
    target = prints.where(F.col("tree") == F.lit(best))
    summaries = kept(summarised(clade_values(target, prints, full, list(dict.fromkeys(["height", *attributes]))), mass))
    inner = target.where("size > 1").join(credibility, "clade").select("node", "credibility")
    summaries = summaries.join(inner.where(F.col("credibility") < limit).select("node"), "node", "left_anti")
    added = notes(summaries, inner, mass)
    own = full.where(F.col("tree") == F.lit(best)).select("tree", "node", "parent", F.col(name).cast("string").alias("label"), "height")
    shown = summaries.where("name = 'height'").select("node", "mean", "median")
    own = own.join(shown, "node", "left").withColumn("height", trees.mapped_height(heights)).select("tree", "node", "parent", "label", "height")
    own = with_lengths(own).withColumn("length", F.coalesce("length", F.lit(0.0)))
    entries = added.groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("meta"))
    return own.join(entries, "node", "left").select("tree", "node", "parent", "label", "height", "length", "meta")
