"""Queries of tree labels, start trees, chosen assignments and the checks of embedded texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genes, likelihood, reads, trees
from ..sources import text as sources
from .catalog import BRANCH_SQL, GENE_SQL, _branch_genes, _cell_matrices, _leaf_likelihoods, all_cells, query, r6

CLASS_SQL = "k AS (SELECT bg.*, CASE WHEN count(*) OVER (PARTITION BY site, gene) > 1 OR event <> 'SM' THEN '_fsa' ELSE '_isa' END AS model FROM bg), x AS (SELECT k.node, k.model, k.event, k.gene, s.chrom, s.pos, s.ref, s.alt FROM k JOIN sites s USING (site))"
NOTE_SQL = " UNION ALL ".join(
    f"SELECT node, concat('{key}', {ending}) AS key, concat('{{', string_agg(CAST({column} AS VARCHAR), ',' ORDER BY chrom, pos, event, gene), '}}') AS value FROM x GROUP BY node, {ending}"
    for key, column in genes.NOTES.items()
    for ending in ("''", "model")
)


@query("sites genes nodes node_gt", f"WITH {BRANCH_SQL}, {GENE_SQL}, {CLASS_SQL} {NOTE_SQL}")
def k13_gene_notes(sites, g, nodes, gt):
    return genes.gene_notes(genes.site_classes(_branch_genes(sites, g, nodes, gt)).join(sites, "site"))


@query("node_gt", "SELECT node, 'genotypes' AS key, concat('{', string_agg(genotype, ',' ORDER BY site), '}') AS value FROM node_gt GROUP BY node")
def k09_genotype_notes(gt):
    return genes.genotype_notes(gt)


@query(
    "gt_trace",
    "WITH o AS (SELECT DISTINCT site AS pattern, sample % 2 AS half, CASE genotype WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS a, ado AS b, CAST(sample % 3 AS INT) AS c, CAST(cell AS INT) AS d FROM gt_trace) SELECT DISTINCT r.pattern, concat_ws(',', s.a, s.b, r.c, r.d) AS assignment FROM o r JOIN o s ON r.pattern = s.pattern AND r.b = s.b AND r.half = 0 AND s.half = 1",
)
def j17_recombined(trace):
    genotype = F.when(F.col("genotype") == "F", 0).when(F.col("genotype") == "O", 1).otherwise(2)
    parts = [genotype, F.col("ado"), F.col("sample") % 3, F.col("cell")]
    rows = trace.select(F.col("site").alias("pattern"), (F.col("sample") % 2).alias("half"), F.array(*[x.cast("int") for x in parts]).alias("assignment"))
    found = likelihood.recombined(rows.where("half = 0"), rows.where("half = 1"), [0, 1], 1)
    return found.select("pattern", F.array_join(F.col("assignment").cast("array<string>"), ",").alias("assignment"))


@query("reads")
def t10_chosen_assignments(r):
    tree, r = all_cells(r)
    partials = _leaf_likelihoods(r).withColumnRenamed("site", "pattern")
    found = likelihood.chosen_assignments(partials, tree, _cell_matrices(tree))
    return found.withColumn("log_likelihood", r6("log_likelihood")).withColumn("node_score", r6("node_score"))


@query("nodes", "SELECT tree, node, round(rate * 0.3, 6) AS branch_rate FROM (SELECT tree, node, 0.5 + length(node) / 4.0 AS rate FROM nodes)")
def f23_calling_rates(nodes):
    rated = nodes.withColumn("rate", 0.5 + F.length("node") / 4)
    return trees.calling_rates(rated, 0.3, only_length=False).select("tree", "node", r6("branch_rate").alias("branch_rate"))


@query("nodes", "SELECT tree, node, round(CASE WHEN (tree, node) IN (SELECT (tree, parent) FROM nodes WHERE parent IS NOT NULL) THEN height * 1.5 ELSE height END, 6) AS height FROM nodes")
def t16_scaled_heights(nodes):
    return trees.scaled_heights(nodes, 1.5).select("tree", "node", r6("height").alias("height"))


@query("cells", "WITH n AS (SELECT count(*) AS n FROM cells) SELECT cell AS node, greatest(cell, 1) + n - 1 AS parent, CAST(cell AS VARCHAR) AS label, 0.0::DOUBLE AS height FROM cells, n UNION ALL SELECT n + i, CASE WHEN i < n - 1 THEN n + i + 1 END, NULL, round(0.5 + (i + 1) * 0.25, 6) FROM n, unnest(range(n)) AS u(i)")
def t13_caterpillar(cells):
    tips = cells.select(F.col("cell").alias("place"), F.col("cell").cast("string").alias("label"))
    return trees.caterpillar(tips, 0.5, 0.25).withColumn("height", r6("height"))


@query("calls", "SELECT 2 * count(DISTINCT cell) - 1 AS dimension FROM calls WHERE cell NOT IN (3, 5)")
def p18_clock_dimension(calls):
    spark = calls.sparkSession
    names = reads.known_names(calls, spark.createDataFrame([(3,), (5,)], "cell long"))
    return trees.clock_dimension(reads.excluded(calls, names))


@query("background", "SELECT name, n_reads, occurrences FROM background")
def s09_embedded_background(background):
    pair = F.concat_ws(",", F.col("n_reads").cast("string"), F.col("occurrences").cast("string"))
    texts = background.groupBy("name").agg(F.array_join(F.collect_list(pair), ";").alias("background"))
    return sources.embedded_background(texts)
