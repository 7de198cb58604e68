"""Trees as adjacency tables: order, clades, consensus, intervals.

A tree is rows (tree, node, parent, height). Descendants come from joining each node with its ancestors, whose
distance doubles with each join: as many joins as the depth has binary digits, over all trees at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import kept


def ancestors(nodes: DataFrame) -> DataFrame:
    """(tree, node, ancestor, steps) pairs, each node being its own ancestor in 0 steps; an error if there is a cycle.

    ``jump`` leads from nodes to their ancestors 1, 2, 4, ... steps up, until nobody has one.
    """
    out = kept(nodes.select("tree", "node", F.col("node").alias("ancestor"), F.lit(0).alias("steps")))
    jump = kept(nodes.where("parent IS NOT NULL").select("tree", F.col("node").alias("ancestor"), F.col("parent").alias("up")))
    most = out.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    far = 1
    while jump.take(1):
        if far > most:
            raise ValueError("a tree has a cycle")
        higher = out.join(jump, ["tree", "ancestor"]).select("tree", "node", F.col("up").alias("ancestor"), (F.col("steps") + far).alias("steps"))
        out = kept(out.unionByName(higher))
        jump = kept(jump.join(jump.select("tree", F.col("ancestor").alias("up"), F.col("up").alias("top")), ["tree", "up"]).select("tree", "ancestor", F.col("top").alias("up")))
        far *= 2
    return out


def preorder(nodes: DataFrame) -> DataFrame:
    """(tree, node, depth, place): the place of each node when parents come before children and siblings by name."""
    above = ancestors(nodes)
    path = F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("s"), F.col("ancestor").alias("a"))))
    paths = above.groupBy("tree", "node").agg(F.transform(path, lambda x: x["a"]).alias("path"), F.max("steps").alias("depth"))
    return paths.select("tree", "node", F.col("depth"), F.row_number().over(Window.partitionBy("tree").orderBy("path")).alias("place"))


def clades(nodes: DataFrame) -> DataFrame:
    """(tree, node, clade, size): the tips below each node, in order, joined by commas."""
    tips = nodes.select("tree", "node").join(nodes.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    below = ancestors(nodes).join(tips, ["tree", "node"]).select("tree", F.col("ancestor").alias("node"), F.col("node").alias("tip"))
    found = below.groupBy("tree", "node").agg(F.sort_array(F.collect_set("tip")).alias("tips"))
    return found.select("tree", "node", F.array_join("tips", ",").alias("clade"), F.size("tips").cast("long").alias("size"))


def clade_credibility(clade_rows: DataFrame, n_trees: int) -> DataFrame:
    """(clade, n, credibility) over distinct clades of each tree."""
    seen = clade_rows.select("tree", "clade").distinct()
    return seen.groupBy("clade").agg(F.count(F.lit(1)).alias("n")).withColumn("credibility", F.col("n") / n_trees)


def tree_scores(clade_rows: DataFrame, credibility: DataFrame) -> DataFrame:
    """(tree, sum_cred, log_cred) from the credibility of each tree's clades."""
    own = clade_rows.select("tree", "clade").distinct().join(credibility, "clade")
    return own.groupBy("tree").agg(F.sum("credibility").alias("sum_cred"), F.sum(F.log("credibility")).alias("log_cred"))


def best_tree(scores: DataFrame, by: str = "log_cred") -> DataFrame:
    """The first tree with the highest score."""
    return scores.orderBy(F.desc(by), "tree").limit(1)


def clade_heights(target: DataFrame, sampled: DataFrame, heights: DataFrame) -> DataFrame:
    """(clade, tree, height): heights that the sampled trees give to the clades of a target tree."""
    wanted = target.select("clade").distinct()
    return sampled.join(wanted, "clade").join(heights.select("tree", "node", "height"), ["tree", "node"]).select("clade", "tree", "height")


def numbered_clades(clade_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct clades by number, (number, clade), and their tips, (number, size, tip).

    A clade's text lists all its tips: rows of single tips carry the number, the text is met again at the end.
    """
    numbered = kept(clade_rows.select("clade", "size").distinct().withColumn("number", F.monotonically_increasing_id()))
    return numbered.select("number", "clade"), numbered.select("number", "size", F.explode(F.split("clade", ",")).alias("tip"))


def common_ancestors(target: DataFrame, nodes: DataFrame) -> DataFrame:
    """(clade, tree, node, height): in every tree the most recent node above all tips of each target clade.

    Tips of a clade are joined with their ancestors; a node above all of them is counted once for each tip.
    """
    texts, tips = numbered_clades(target)
    above = ancestors(nodes).select("tree", F.col("node").alias("tip"), F.col("ancestor").alias("node"))
    met = tips.join(above, "tip").groupBy("number", "size", "tree", "node").agg(F.count(F.lit(1)).alias("n")).where("n = size")
    placed = met.join(nodes.select("tree", "node", "height"), ["tree", "node"])
    lowest = placed.groupBy("number", "tree").agg(F.min(F.struct("height", "node")).alias("m"))
    return lowest.join(texts, "number").select("clade", "tree", F.col("m.node").alias("node"), F.col("m.height").alias("height"))


def subsets(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole): the clades of ``parts`` that lie inside a larger one of ``wholes``, both of (clade, size)."""
    part, tips = numbered_clades(parts)
    whole, wide = numbered_clades(wholes)
    met = tips.join(wide.select(F.col("number").alias("other"), F.col("size").alias("m"), "tip"), "tip").where("size < m")
    inside = met.groupBy("number", "other", "size").agg(F.count(F.lit(1)).alias("k")).where("k = size")
    named = inside.join(part.withColumnRenamed("clade", "part"), "number")
    return named.join(whole.select(F.col("number").alias("other"), F.col("clade").alias("whole")), "other").select("part", "whole")


def coalescent_intervals(nodes: DataFrame) -> DataFrame:
    """(tree, height, width, lineages, joins): the intervals between events from the tips up, in order.

    A tip adds a lineage at its height, an inner node joins its children into one; ``joins`` counts the coalescences
    at the interval's upper end, 0 where it ends with a tip or with the trunk.
    """
    children = nodes.where("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("c"))
    events = nodes.join(children, ["tree", "node"], "left").select("tree", F.col("height").cast("double").alias("height"), F.when(F.col("c").isNull(), 1).otherwise(1 - F.col("c")).alias("change"), F.coalesce(F.col("c") - 1, F.lit(0)).alias("joined"))
    steps = events.groupBy("tree", "height").agg(F.sum("change").alias("change"), F.sum("joined").alias("joined"))
    up = Window.partitionBy("tree").orderBy("height")
    run = steps.withColumn("lineages", F.sum("change").over(up)).withColumn("width", F.lead("height").over(up) - F.col("height"))
    return run.withColumn("joins", F.lead("joined").over(up)).where("width IS NOT NULL").select("tree", "height", "width", "lineages", "joins")


def coalescent_log_likelihood(nodes: DataFrame, population: float, expected_trunk: float | None = None) -> DataFrame:
    """(tree, log_likelihood) under a constant population.

    An interval waits at rate k(k-1)/2 / N; each coalescence at its end has density 1/N, a tip that enters has none.
    The trunk, the last interval of one lineage, is exponential with mean ``expected_trunk`` where that is given.
    """
    from math import log

    pairs = F.col("lineages") * (F.col("lineages") - 1) / 2
    each = coalescent_intervals(nodes)
    term = -pairs * F.col("width") / population - F.col("joins") * log(population)
    if expected_trunk is None:
        return each.groupBy("tree").agg(F.sum(term).alias("log_likelihood"))
    last = F.max_by(F.when((F.col("joins") == 0) & (F.col("lineages") == 1), F.col("width")), "height")
    summed = each.groupBy("tree").agg(F.sum(term).alias("s"), last.alias("trunk"))
    return summed.select("tree", (F.col("s") + F.coalesce(-F.col("trunk") / expected_trunk - log(expected_trunk), F.lit(0.0))).alias("log_likelihood"))


def local_clock_rates(nodes: DataFrame, mean_rate: float = 1.0, root_rate: bool = False, scaled: bool = True) -> DataFrame:
    """(tree, node, unscaled, rate): products of the multipliers from the root down, scaled to ``mean_rate``.

    ``nodes`` has ``multiplier``, that of nodes where the rate changes (null elsewhere). The root's own multiplier
    counts only if asked. The scale is the sum of branch times over that of branch times times rates; the root has
    no branch, and a branch is as long as the difference of heights.
    """
    times = nodes.select("tree", "node", "parent", "height", "multiplier")
    upper = nodes.select("tree", F.col("node").alias("parent"), F.col("height").alias("top"))
    applied = times.withColumn("m", F.when(F.col("parent").isNull() & F.lit(not root_rate), F.lit(1.0)).otherwise(F.coalesce("multiplier", F.lit(1.0))))
    product = ancestors(nodes).join(applied.select("tree", F.col("node").alias("ancestor"), "m"), ["tree", "ancestor"])
    unscaled = product.groupBy("tree", "node").agg(F.exp(F.sum(F.log("m"))).alias("unscaled"))
    timed = unscaled.join(times.join(upper, ["tree", "parent"], "left").select("tree", "node", (F.col("top") - F.col("height")).alias("time")), ["tree", "node"])
    sums = timed.groupBy("tree").agg((F.sum("time") / F.sum(F.col("time") * F.col("unscaled")) * mean_rate).alias("scale"))
    found = timed.join(sums, "tree")
    return found.select("tree", "node", "unscaled", (F.col("unscaled") * F.col("scale") if scaled else F.col("unscaled")).alias("rate"))


def mapped_height(option: str, own: str = "height", mean: str = "mean", median: str = "median"):
    """The height a summarised node shows: its own, or the mean or median of the samples where there are any."""
    return {"keep": F.col(own), "mean": F.coalesce(mean, own), "median": F.coalesce(median, own)}[option]


def calling_rates(nodes: DataFrame, mean_rate: float, only_length: bool, scaled: bool = True) -> DataFrame:
    """``nodes`` with ``branch_rate`` as variant calling uses it.

    With ``only_length`` a branch's own ``rate`` is taken as part of its length. A local clock that is not scaled
    leaves the mean rate out.
    """
    own = F.lit(1.0) if only_length else F.col("rate").cast("double")
    return nodes.withColumn("branch_rate", own * (mean_rate if scaled else 1.0))


def scaled_heights(nodes: DataFrame, factor: float) -> DataFrame:
    """``nodes`` with the heights of inner nodes times ``factor``; a parent below its child is an error."""
    inner = nodes.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node"), F.lit(True).alias("is_inner")).distinct()
    new = nodes.join(inner, ["tree", "node"], "left").withColumn("height", F.col("height") * F.when(F.col("is_inner"), F.lit(factor)).otherwise(1.0)).drop("is_inner")
    tops = new.select("tree", F.col("node").alias("parent"), F.col("height").alias("top"))
    height = F.when(F.col("top") < F.col("height"), F.raise_error(F.lit("Scaling gives a negative branch length")).cast("double")).otherwise(F.col("height"))
    return new.join(tops, ["tree", "parent"], "left").withColumn("height", height).select(*nodes.columns)


def caterpillar(tips: DataFrame, lowest: float, step: float) -> DataFrame:
    """(node, parent, label, height): the ladder over ``tips`` (place from 0, label), with a trunk above it.

    Each tip joins all before it; the i-th inner node is ``lowest + i step`` high and the root one step above the last.
    """
    n = tips.count()
    leaves = tips.select(F.col("place").cast("long").alias("node"), (F.greatest(F.col("place"), F.lit(1)) + (n - 1)).cast("long").alias("parent"), "label", F.lit(0.0).alias("height"))
    node = F.col("id")
    above = tips.sparkSession.range(n, 2 * n).select(node.alias("node"), F.when(node < 2 * n - 1, node + 1).alias("parent"), F.lit(None).cast("string").alias("label"), (lowest + (node - n + 1) * step).alias("height"))
    return leaves.unionByName(above)


def clock_dimension(cells: DataFrame) -> DataFrame:
    """(dimension): one rate for each branch of a rooted binary tree over ``cells``."""
    return cells.select("cell").distinct().agg((2 * F.count(F.lit(1)) - 1).alias("dimension"))
