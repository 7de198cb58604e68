"""Connected components of an edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of ``edges`` (u, v) is connected to; isolated nodes are not listed.

    Each round points every node at its smallest neighbour or itself and contracts the graph to those; rounds
    end when no edge is left. Nothing is collected; each round is written to the shared folder.
    """
    edges = written(edges.where("u <> v").select("u", "v").distinct())
    roots = None
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = written(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("root")))
        if roots is None:
            roots = hook
        else:
            step = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = written(roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        ends = [hook.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("u", "v")]
        moved = edges.join(ends[0], "u").join(ends[1], "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))
        edges = written(moved.where("u <> v").distinct())
    if roots is None:
        kind = edges.schema["u"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return roots
