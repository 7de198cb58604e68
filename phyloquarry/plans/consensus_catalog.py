"""Queries of consensus trees, which are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import consensus
from ..operators.lineage import shared_folder
from ..sinks import text as sinks
from ..sources import newick
from .catalog import clade_query

#: The best tree's nodes with the values that all trees have for their clades; nodes of one clade in a tree are told apart
#: from below.
VALUE_SQL = """, pl AS (SELECT cl.*, n.height, p.height - n.height AS length, row_number() OVER (PARTITION BY cl.tree, clade ORDER BY n.height) AS place
    FROM cl JOIN nodes n USING (tree, node) LEFT JOIN nodes p ON p.tree = n.tree AND p.node = n.parent),
  best AS (SELECT tree FROM (SELECT tree, round(sum(ln(credibility)), 9) AS s FROM (SELECT DISTINCT tree, clade FROM cl) JOIN cred USING (clade) GROUP BY tree) ORDER BY s DESC, tree LIMIT 1),
  v AS (SELECT t.node AS label, t.clade, t.size, s.height AS h, s.length AS l FROM pl t JOIN best USING (tree) JOIN pl s ON s.clade = t.clade AND s.place = t.place),
  k AS (SELECT label, clade, size, count(*) AS cnt, floor(0.95 * count(*) + 0.5)::BIGINT AS k, list_sort(list(h)) AS hs, avg(h) AS h, avg(l) AS l, quantile_cont(h, 0.5) AS m FROM v GROUP BY label, clade, size),
  w AS (SELECT *, list_min(list_transform(range(1, cnt - k + 2), lambda i: hs[i + k - 1] - hs[i])) AS width FROM k),
  e AS (SELECT *, list_filter(range(1, cnt - k + 2), lambda i: hs[i + k - 1] - hs[i] = width)[1] AS at_, hs[1] < hs[cnt] AS varies FROM w)
  SELECT label, round(h, 5) AS height, CASE WHEN size > 1 THEN round(credibility, 5) END AS posterior, round(h, 5) AS height_mean, CASE WHEN varies THEN round(m, 5) END AS height_median,
    CASE WHEN varies THEN round(hs[at_], 5) END AS hpd_low, CASE WHEN varies THEN round(hs[at_ + k - 1], 5) END AS hpd_high,
    CASE WHEN varies THEN round(hs[1], 5) END AS range_low, CASE WHEN varies THEN round(hs[cnt], 5) END AS range_high, round(l, 5) AS length_mean FROM e JOIN cred USING (clade)"""


@clade_query(VALUE_SQL)
def k11_annotated_tree(nodes):
    found = consensus.annotated_tree(nodes, ["height", "length"], heights="mean")
    path = f"{shared_folder(nodes.sparkSession)}/{uuid.uuid4().hex}.tree"
    sinks.write_lines(newick.nexus(newick.to_newick(found)), path)
    meta = lambda k: F.col("meta")[k].cast("double")
    end = lambda k, i: r6_at(F.get(F.split(F.translate(F.col("meta")[k], "{}", ""), ","), F.lit(i)).cast("double"))
    r6_at = lambda c: F.round(c, 5)
    back = newick.read_tree(nodes.sparkSession, path)
    return back.select(
        "label", r6_at(F.col("height")).alias("height"), r6_at(meta("posterior")).alias("posterior"), r6_at(meta("height")).alias("height_mean"), r6_at(meta("height_median")).alias("height_median"),
        end("height_95%_HPD", 0).alias("hpd_low"), end("height_95%_HPD", 1).alias("hpd_high"), end("height_range", 0).alias("range_low"), end("height_range", 1).alias("range_high"),
        r6_at(meta("length")).alias("length_mean"),
    )


@clade_query(VALUE_SQL.replace("SELECT label, round(h, 5) AS height, CASE", "SELECT label, CASE WHEN size = 1 OR credibility >= 0.9 THEN round(h, 5) END AS height_mean, CASE", 1).split(", round(h, 5) AS height_mean, CASE WHEN varies")[0] + " FROM e JOIN cred USING (clade)")
def p13_posterior_limit(nodes):
    """Clades below the limit tell their credibility alone."""
    found = consensus.annotated_tree(nodes, ["height", "length"], limit=0.9)
    return found.select("label", F.round(F.col("meta")["height"].cast("double"), 5).alias("height_mean"), F.round(F.col("meta")["posterior"].cast("double"), 5).alias("posterior"))
