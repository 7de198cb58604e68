"""One query for each operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions, special
from ..operators import calls, consensus, contours, genes, leaves, likelihood, reads, summaries, trees
from .views import view, with_views

#: Name to (callable, SQL or None).
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(views: str, sql: str | None = None):
    """Registers a function of the named views under its own name."""
    names = views.split()

    def add(build):
        QUERIES[build.__name__] = (lambda spark, sf_dir: build(*(view(spark, sf_dir, n) for n in names)), with_views(names, sql) if sql else None)
        return build

    return add


def r6(c):
    return F.round(c, 6)


# Projections and filters


@query("sites", r"SELECT site, regexp_extract(chrom, '^(.*?)(1[0-9]|2[0-2]|[1-9]|[XYxy]|[Mm][Tt])$', 1) AS chrom_prefix, regexp_extract(chrom, '^(.*?)(1[0-9]|2[0-2]|[1-9]|[XYxy]|[Mm][Tt])$', 2) AS chrom_key, try_cast(regexp_extract(chrom, '^(.*?)(1[0-9]|2[0-2]|[1-9]|[XYxy]|[Mm][Tt])$', 2) AS INT) AS chrom_num FROM sites")
def p01_chromosome_label(sites):
    return reads.chromosome(sites).select("site", "chrom_prefix", "chrom_key", "chrom_num")


@query("sites", "SELECT site, chrom FROM sites WHERE NOT regexp_matches(chrom, '[Mm][Tt]$') AND NOT regexp_matches(chrom, '[XYxy]$')")
def p02_autosomes(sites):
    return reads.autosomes(sites).select("site", "chrom")


@query("reads", "SELECT site, cell, cov FROM reads WHERE cell IN (SELECT cell FROM cells ORDER BY cell LIMIT 5)")
def p03_first_cells(r):
    return reads.first_cells(r, 5).select("site", "cell", "cov")


@query("sites", "SELECT site FROM (SELECT site, row_number() OVER (ORDER BY site) AS ix FROM sites) WHERE ix <= 100")
def p04_first_sites(sites):
    return sites.select("site").orderBy("site").limit(100)


@query("cells", "SELECT cell FROM cells WHERE cell NOT IN (SELECT cell FROM cells WHERE cell % 4 = 0)")
def j01_excluded_cells(cells):
    return reads.excluded(cells, cells.where("cell % 4 = 0"))


@query("reads", "WITH m AS (SELECT site, count(*) FILTER (cov = 0) AS n_missing, count(*) AS n FROM reads GROUP BY site), t AS (SELECT sum(n_missing) AS am, sum(n) AS an FROM m), o AS (SELECT site, n_missing, am, an, am - coalesce(sum(n_missing) OVER w, 0) AS ml, an - coalesce(sum(n) OVER w, 0) AS nl FROM m, t WINDOW w AS (ORDER BY n_missing DESC, site ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT site, n_missing FROM o WHERE am <= 0.03 * an OR ml <= 0.03 * nl")
def p06_missing_threshold(r):
    return reads.below_missing(r, 0.03)


@query("reads", "SELECT site, count(*) FILTER (cov = 0) AS n_missing, count(*) AS n_entries FROM reads GROUP BY site")
def p07_missing_per_site(r):
    return reads.missing_per_site(r)


@query("trace", "SELECT sample, var, value FROM (SELECT *, row_number() OVER (PARTITION BY var ORDER BY sample) AS k, count(*) OVER (PARTITION BY var) AS n FROM trace) WHERE k > floor(0.1 * n)")
def p08_burn_in(trace):
    return summaries.after_burn_in(trace, 0.1, ["var"])


@query("gt_trace", "SELECT sample, site, cell, genotype, ado FROM (SELECT *, row_number() OVER (PARTITION BY site, cell ORDER BY sample) AS k, count(*) OVER (PARTITION BY site, cell) AS n FROM gt_trace) WHERE k > ceil(0.1 * n)")
def p09_burn_in_up(gt):
    return summaries.after_burn_in(gt, 0.1, ["site", "cell"], up=True)


@query("sites", "SELECT site FROM sites WHERE (site BETWEEN 1 AND 100 AND (site - 1) % 3 = 0) OR site = 7 OR (site BETWEEN 5 AND 50 AND (site - 5) % 9 = 0) OR site BETWEEN 150 AND 160")
def p10_site_ranges(sites):
    return sites.where(reads.site_ranges(r"1-100\3,7,5:50:9,150-160", 1_000_000, F.col("site"))).select("site")


@query("calls", "SELECT site, count(*) FILTER (genotype <> 0) AS n_variant FROM calls GROUP BY site HAVING count(*) FILTER (genotype <> 0) >= 6")
def p11_consensus_sites(c):
    return calls.consensus_sites(c, 6)


@query("gt_trace", "SELECT site, cell, min(genotype) AS genotype FROM gt_trace GROUP BY site, cell")
def p12_first_ambiguous_call(gt):
    return calls.ambiguous(gt.select("site", "cell", "genotype").distinct())


@query("sites", "SELECT site, array_to_string(list_filter([alt, 'N', lower(ref)], lambda x: upper(x) IN ('A', 'C', 'G', 'T')), ',') AS alts FROM sites")
def p14_acgt_alternatives(sites):
    return sites.select("site", F.array_join(reads.acgt(F.array("alt", F.lit("N"), F.lower("ref"))), ",").alias("alts"))


@query("sites reads", "SELECT site, cell, ref_reads AS ref_depth, CASE WHEN alt = 'A' THEN r1 WHEN alt = 'C' THEN r2 WHEN alt = 'G' THEN r3 ELSE 0 END AS alt_depth FROM sites JOIN reads USING (site)")
def p17_allele_depth(sites, r):
    depth = reads.allele_depths(F.col("ref_reads"), F.array("alt"), F.array(F.lit("A"), F.lit("C"), F.lit("G")), F.array("r1", "r2", "r3"))
    return sites.join(r, "site").select("site", "cell", depth[0].alias("ref_depth"), depth[1].alias("alt_depth"))


@query("calls", "SELECT site, cell, CASE genotype WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' ELSE '1/1' END AS alphabet, genotype AS ternary, genotype AS n_alt, genotype <> 0 AS is_variant FROM calls")
def p23_genotype_codes(c):
    dim = calls.genotype_table(c.sparkSession)
    return c.join(F.broadcast(dim), "genotype").select("site", "cell", "alphabet", "ternary", "n_alt", "is_variant")


@query("reads", "WITH o AS (SELECT site, cell, cov + 1 AS cov FROM reads), g AS (SELECT site, exp(avg(ln(cov))) AS geo FROM o GROUP BY site) SELECT cell, round(quantile_cont(cov / geo, 0.5), 6) AS size_factor FROM o JOIN g USING (site) GROUP BY cell")
def p25_zero_coverage_mode(r):
    """Size factors where one is added to every coverage, so that none is zero."""
    return reads.size_factors(reads.zero_coverage(r, 1)).select("cell", r6("size_factor").alias("size_factor"))


# Joins


@query("cells", "SELECT cell, row_number() OVER (ORDER BY name) AS ix FROM (SELECT cell, concat('cell', CAST(cell AS VARCHAR(8))) AS name FROM cells)")
def j02_cell_permutation(cells):
    named = cells.withColumn("name", F.concat(F.lit("cell"), F.col("cell").cast("string")))
    return summaries.ranked(named.withColumn("_one", F.lit(1)), ["_one"], ["name"], "ix").select("cell", F.col("ix").cast("long"))


@query("reads", "WITH v AS (SELECT site, flatten(list([r1, r2, r3, cov] ORDER BY cell)) AS counts FROM reads GROUP BY site) SELECT site, dense_rank() OVER (ORDER BY counts) AS pattern_id FROM v")
def o11_array_order(r):
    return reads.vector_ids(reads.count_vectors(r, ["r1", "r2", "r3", "cov"]))


@query("pattern_reads", "WITH p AS (SELECT site, string_agg(CAST(cov AS VARCHAR), ';' ORDER BY cell) AS pattern FROM pattern_reads GROUP BY site), w AS (SELECT pattern, count(*) AS weight FROM p GROUP BY pattern) SELECT site, pattern, weight FROM p JOIN w USING (pattern)")
def j03_site_patterns(p):
    return reads.site_patterns(p, ["cov"]).join(reads.patterns(p, ["cov"]), "pattern").select("site", "pattern", "weight")


@query("sites genes", "WITH m AS (SELECT s.site, s.chrom, s.pos, g.gene, row_number() OVER (PARTITION BY s.site ORDER BY g.start_pos, g.end_pos, upper(g.gene), g.gene) AS k FROM sites s JOIN genes g ON s.chrom = g.chrom AND s.pos BETWEEN g.start_pos AND g.end_pos) SELECT site, chrom, pos, gene FROM m WHERE k = 1")
def j07_interval_join(sites, g):
    return genes.first_genes(sites.select("site", "chrom", "pos"), g)


@query("genes", "SELECT chrom, start_pos, end_pos, gene FROM genes WHERE gene IN (SELECT gene FROM genes WHERE gene LIKE '%1')")
def j08_gene_whitelist(g):
    return genes.listed_genes(g, g.where("gene LIKE '%1'")).select("chrom", "start_pos", "end_pos", "gene")


EVENT_SQL = " UNION ALL ".join(f"SELECT '{p}' AS p, '{c}' AS c, '{e}' AS event" for p, c, e in genes.EVENTS)
BRANCH_SQL = f"b AS (SELECT k.site, k.node, n.parent, e.event FROM node_gt k JOIN nodes n ON n.tree = 0 AND n.node = k.node JOIN node_gt u ON u.site = k.site AND u.node = n.parent JOIN ({EVENT_SQL}) e ON e.p = u.genotype AND e.c = k.genotype)"
GENE_SQL = "m AS (SELECT s.site, g.gene, row_number() OVER (PARTITION BY s.site ORDER BY g.start_pos, g.end_pos, upper(g.gene), g.gene) AS k FROM sites s JOIN genes g ON s.chrom = g.chrom AND s.pos BETWEEN g.start_pos AND g.end_pos), bg AS (SELECT b.site, b.node, b.event, m.gene FROM b JOIN m ON m.site = b.site AND m.k = 1)"


def _branches(nodes, gt):
    return genes.branch_events(nodes.where("tree = 0"), gt, genes.event_table(nodes.sparkSession))


def _branch_genes(sites, g, nodes, gt):
    return _branches(nodes, gt).join(genes.first_genes(sites.select("site", "chrom", "pos"), g).select("site", "gene"), "site")


@query("nodes node_gt", f"WITH {BRANCH_SQL} SELECT * FROM b")
def j09_branch_events(nodes, gt):
    return _branches(nodes, gt)


@query("sites genes nodes node_gt", f"WITH {BRANCH_SQL}, {GENE_SQL} SELECT site, node, event, gene, CASE WHEN count(*) OVER (PARTITION BY site, gene) > 1 OR event <> 'SM' THEN 'FSA' ELSE 'ISA' END AS model FROM bg")
def a33_site_classes(sites, g, nodes, gt):
    return genes.site_classes(_branch_genes(sites, g, nodes, gt)).select("site", "node", "event", "gene", "model")


@query("sites genes nodes node_gt", f"WITH {BRANCH_SQL}, {GENE_SQL} SELECT node, string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes FROM bg GROUP BY node")
def a34_genes_by_branch(sites, g, nodes, gt):
    return genes.genes_by_branch(_branch_genes(sites, g, nodes, gt))


@query("reads", "SELECT * FROM (SELECT concat('site', lpad(CAST(site AS VARCHAR), 6, '0')) AS pseudo, sum(cov) AS cov FROM reads GROUP BY site)")
def j06_site_map(r):
    named = F.concat(F.lit("site"), F.lpad(F.col("site").cast("string"), 6, "0"))
    site_map = r.select("site", named.alias("pseudo")).distinct()
    return r.groupBy("site").agg(F.sum("cov").alias("cov")).join(site_map, "site").select("pseudo", "cov")


# Aggregations


@query("reads", "WITH v AS (SELECT site, flatten(list([r1, r2, r3, cov] ORDER BY cell)) AS counts FROM reads GROUP BY site) SELECT site, dense_rank() OVER (ORDER BY counts) AS pattern_id FROM v")
def o11_array_order(r):
    return reads.vector_ids(reads.count_vectors(r, ["r1", "r2", "r3", "cov"]))


@query("pattern_reads", "WITH p AS (SELECT site, string_agg(CAST(cov AS VARCHAR), ';' ORDER BY cell) AS pattern FROM pattern_reads GROUP BY site) SELECT pattern, count(*) AS weight FROM p GROUP BY pattern")
def a01_site_patterns(p):
    return reads.patterns(p, ["cov"])


@query("reads", "WITH v AS (SELECT site, flatten(list([r1, r2, r3, cov] ORDER BY cell)) AS counts FROM reads GROUP BY site) SELECT site, dense_rank() OVER (ORDER BY counts) AS pattern_id FROM v")
def o11_array_order(r):
    return reads.vector_ids(reads.count_vectors(r, ["r1", "r2", "r3", "cov"]))


@query("pattern_reads", "WITH p AS (SELECT site, string_agg(CAST(cov AS VARCHAR), ';' ORDER BY cell) AS pattern FROM pattern_reads WHERE site % 3 = 0 GROUP BY site) SELECT pattern, count(*) AS weight FROM p GROUP BY pattern")
def a02_filtered_patterns(p):
    return reads.patterns(p.where("site % 3 = 0"), ["cov"])


@query("background", "SELECT name, sum(occurrences)::BIGINT AS n_points, CASE WHEN sum(occurrences) % 5 = 0 THEN (sum(occurrences) // 5)::BIGINT END AS n_sites FROM background GROUP BY name")
def a03_background_totals(b):
    return reads.background_totals(b, 5)


@query("reads", "SELECT site, round(coalesce(exp(avg(CASE WHEN cov > 0 THEN ln(cov) END)), 0), 6) AS geo FROM reads GROUP BY site")
def a05_geometric_mean(r):
    return r.groupBy("site").agg(r6(special.geometric_mean(F.col("cov"))).alias("geo"))


@query("reads", "WITH g AS (SELECT site, exp(avg(ln(cov))) AS geo FROM reads WHERE cov > 0 GROUP BY site) SELECT cell, round(quantile_cont(cov / geo, 0.5), 6) AS size_factor FROM reads JOIN g USING (site) WHERE cov > 0 GROUP BY cell")
def a06_size_factors(r):
    return reads.size_factors(r).select("cell", r6("size_factor").alias("size_factor"))


@query("reads", "SELECT round(avg(cov) / 2, 6) AS start_cov, round(var_samp(cov) / 4, 6) AS start_var, round(100 * count(*) FILTER (cov = 0) / count(*), 6) AS pct_missing FROM reads")
def a07_start_values(r):
    return reads.start_values(r).select(*[r6(c).alias(c) for c in ("start_cov", "start_var", "pct_missing")])


@query("trace", "SELECT var, round(avg(value), 6) AS finite_mean FROM trace WHERE value <> 0 GROUP BY var")
def a08_finite_mean(trace):
    return trace.groupBy("var").agg(r6(special.finite_mean(F.col("value"), skip_zeros=True)).alias("finite_mean"))


@query("trace", "SELECT var, round(max(value) + ln(sum(exp(value - m))), 6) AS lse FROM (SELECT var, value, max(value) OVER (PARTITION BY var) AS m FROM trace) GROUP BY var")
def a09_log_sum_exp(trace):
    return special.grouped_log_sum_exp(trace, ["var"], "value").select("var", r6("lse").alias("lse"))


@query("trace", "SELECT var, round(min(value), 6) AS low, round(max(value), 6) AS high, min(sample) FILTER (value = lo) AS arg_low, min(sample) FILTER (value = hi) AS arg_high FROM (SELECT *, min(value) OVER (PARTITION BY var) AS lo, max(value) OVER (PARTITION BY var) AS hi FROM trace) GROUP BY var")
def a10_arg_extremes(trace):
    low, high = F.min(F.struct("value", "sample")).alias("l"), F.max(F.struct("value", (-F.col("sample")).alias("s"))).alias("h")
    return trace.groupBy("var").agg(low, high).select("var", r6("l.value").alias("low"), r6("h.value").alias("high"), F.col("l.sample").alias("arg_low"), (-F.col("h.s")).alias("arg_high"))


@query("calls", "SELECT cell, site, cov FROM (SELECT *, rank() OVER (PARTITION BY cell ORDER BY cov DESC) AS k FROM calls) WHERE k = 1")
def a11_argmax_ties(c):
    return summaries.best_with_ties(c, ["cell"], "cov").select("cell", "site", "cov")


TRACE_TAIL = "t AS (SELECT sample, var, value FROM (SELECT *, row_number() OVER (PARTITION BY var ORDER BY sample) AS k, count(*) OVER (PARTITION BY var) AS n FROM trace) WHERE k > floor(0.1 * n))"


@query("trace", f"WITH {TRACE_TAIL} SELECT var, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM t GROUP BY var")
def a12_estimates(trace):
    return summaries.estimates(summaries.after_burn_in(trace, 0.1, ["var"]), ["var"]).select("var", "n", r6("mean").alias("mean"), r6("median").alias("median"))


@query("reads", "SELECT site, cell % 4 AS category, count(*) AS n, round(avg(cov), 6) AS mean, round(quantile_cont(cov, 0.5), 6) AS median FROM reads GROUP BY site, cell % 4")
def a13_site_estimates(r):
    keyed = r.select("site", (F.col("cell") % 4).alias("category"), F.col("cov").cast("double").alias("value"))
    return summaries.estimates(keyed, ["site", "category"]).select("site", "category", "n", r6("mean").alias("mean"), r6("median").alias("median"))


@query("trace", f"WITH {TRACE_TAIL}, s AS (SELECT var, 1.06 * stddev_samp(value) * pow(count(*), -0.2) AS w FROM t GROUP BY var), d AS (SELECT a.var, a.sample, a.value, sum(exp(-0.5 * ((a.value - b.value) / w) * ((a.value - b.value) / w))) AS d FROM t a JOIN t b USING (var) JOIN s USING (var) GROUP BY a.var, a.sample, a.value), m AS (SELECT *, max(d) OVER (PARTITION BY var) AS top FROM d) SELECT var, round(arg_min(value, sample), 6) AS mode FROM m WHERE d >= top * (1 - 1e-12) GROUP BY var")
def a14_kde_mode(trace):
    return summaries.kde_mode(summaries.after_burn_in(trace, 0.1, ["var"]), ["var"]).withColumn("mode", r6("mode"))


@query("gt_trace", "SELECT site, cell, genotype, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY site, cell), 6) AS share FROM gt_trace GROUP BY site, cell, genotype")
def a15_genotype_frequencies(gt):
    return calls.sampled_states(gt, ["site", "cell"], "genotype").withColumn("share", r6("share"))


CLADE_SQL = "RECURSIVE up AS (SELECT tree, node, node AS anc, 0 AS steps FROM nodes UNION ALL SELECT u.tree, u.node, n.parent, u.steps + 1 FROM up u JOIN nodes n ON n.tree = u.tree AND n.node = u.anc WHERE n.parent IS NOT NULL), tips AS (SELECT tree, node FROM nodes WHERE (tree, node) NOT IN (SELECT (tree, parent) FROM nodes WHERE parent IS NOT NULL)), cl AS (SELECT u.tree, u.anc AS node, string_agg(u.node, ',' ORDER BY u.node) AS clade, count(*) AS size FROM up u JOIN tips t ON t.tree = u.tree AND t.node = u.node GROUP BY u.tree, u.anc), cred AS (SELECT clade, count(DISTINCT tree) AS n, count(DISTINCT tree) / 5.0 AS credibility FROM cl GROUP BY clade)"


def clade_sql(body: str) -> str:
    return with_views(["nodes"], f"WITH {CLADE_SQL.removeprefix('RECURSIVE ')}{body if body.startswith(',') else ' ' + body}").replace("WITH ", "WITH RECURSIVE ", 1)


def clade_query(body: str | None):
    def add(build):
        QUERIES[build.__name__] = (lambda spark, sf_dir: build(view(spark, sf_dir, "nodes")), clade_sql(body) if body else None)
        return build

    return add


@clade_query("SELECT tree, node, clade, size FROM cl")
def u04_clades(nodes):
    return trees.clades(nodes)


@clade_query("SELECT clade, n, round(credibility, 6) AS credibility FROM cred")
def a16_clade_credibility(nodes):
    return trees.clade_credibility(trees.clades(nodes), 5).withColumn("credibility", r6("credibility"))


@clade_query("SELECT tree, round(sum(credibility), 6) AS sum_cred, round(sum(ln(credibility)), 6) AS log_cred FROM (SELECT DISTINCT tree, clade FROM cl) JOIN cred USING (clade) GROUP BY tree")
def a18_tree_scores(nodes):
    c = consensus.fingerprints(nodes)
    return trees.tree_scores(c, trees.clade_credibility(c, 5)).select("tree", r6("sum_cred").alias("sum_cred"), r6("log_cred").alias("log_cred"))


@clade_query("SELECT tree FROM (SELECT tree, round(sum(ln(credibility)), 9) AS s FROM (SELECT DISTINCT tree, clade FROM cl) JOIN cred USING (clade) GROUP BY tree) ORDER BY s DESC, tree LIMIT 1")
def a20_best_tree(nodes):
    c = consensus.fingerprints(nodes)
    scores = trees.tree_scores(c, trees.clade_credibility(c, 5)).withColumn("log_cred", F.round("log_cred", 9))
    return trees.best_tree(scores).select("tree")


@clade_query("SELECT c.clade, c.tree, n.height FROM cl c JOIN nodes n USING (tree, node) WHERE c.clade IN (SELECT clade FROM cl WHERE tree = 0)")
def j10_clade_heights(nodes):
    c = trees.clades(nodes)
    return trees.clade_heights(c.where("tree = 0"), c, nodes)


@clade_query("SELECT clade, round(avg(height), 6) AS mean, round(quantile_cont(height, 0.5), 6) AS median, round(min(height), 6) AS low, round(max(height), 6) AS high FROM cl JOIN nodes USING (tree, node) WHERE clade IN (SELECT clade FROM cl WHERE tree = 0) GROUP BY clade")
def a22_clade_summaries(nodes):
    c = trees.clades(nodes)
    heights = trees.clade_heights(c.where("tree = 0"), c, nodes).groupBy("clade")
    return heights.agg(r6(F.avg("height")).alias("mean"), r6(F.percentile("height", F.lit(0.5))).alias("median"), r6(F.min("height")).alias("low"), r6(F.max("height")).alias("high"))


@clade_query("SELECT t.clade, u.tree, min(n.height) AS height FROM (SELECT DISTINCT clade, size FROM cl WHERE tree = 0) t, (SELECT tree, anc, list(node) AS below FROM up GROUP BY tree, anc) u JOIN nodes n ON n.tree = u.tree AND n.node = u.anc WHERE list_has_all(u.below, string_split(t.clade, ',')) GROUP BY t.clade, u.tree")
def j11_common_ancestors(nodes):
    return trees.common_ancestors(trees.clades(nodes).where("tree = 0"), nodes).select("clade", "tree", "height")


@clade_query("SELECT t.clade, round(avg(height), 6) AS mean_height FROM (SELECT t.clade, u.tree, min(n.height) AS height FROM (SELECT DISTINCT clade, size FROM cl WHERE tree = 0) t, (SELECT tree, anc, list(node) AS below FROM up GROUP BY tree, anc) u JOIN nodes n ON n.tree = u.tree AND n.node = u.anc WHERE list_has_all(u.below, string_split(t.clade, ',')) GROUP BY t.clade, u.tree) t GROUP BY t.clade")
def a29_common_ancestor_heights(nodes):
    found = trees.common_ancestors(trees.clades(nodes).where("tree = 0"), nodes)
    return found.groupBy("clade").agg(r6(F.avg("height")).alias("mean_height"))


@clade_query("SELECT tree, node, max(steps) AS depth, row_number() OVER (PARTITION BY tree ORDER BY list(anc ORDER BY steps DESC)) AS place FROM up GROUP BY tree, node")
def t12_preorder(nodes):
    return trees.preorder(nodes)


STEPS_SQL = "WITH k AS (SELECT tree, parent AS node, count(*) AS c FROM nodes WHERE parent IS NOT NULL GROUP BY tree, parent), e AS (SELECT n.tree, n.height, sum(CASE WHEN c IS NULL THEN 1 ELSE 1 - c END) AS change, sum(coalesce(c - 1, 0)) AS joined FROM nodes n LEFT JOIN k USING (tree, node) GROUP BY n.tree, n.height), r AS (SELECT tree, height, sum(change) OVER w AS lineages, lead(height) OVER w - height AS width, lead(joined) OVER w AS joins FROM e WINDOW w AS (PARTITION BY tree ORDER BY height))"


@query("nodes", f"{STEPS_SQL} SELECT tree, round(sum(-lineages * (lineages - 1) / 2 * width / 1.5 - joins * ln(1.5)) + max(CASE WHEN height = 3 THEN -width / 2.5 - ln(2.5) END), 6) AS log_likelihood FROM r WHERE width IS NOT NULL GROUP BY tree")
def a48_coalescent(nodes):
    return trees.coalescent_log_likelihood(nodes, 1.5, 2.5).withColumn("log_likelihood", r6("log_likelihood"))


@query("nodes", f"{STEPS_SQL} SELECT tree, round(height, 6) AS height, round(width, 6) AS width, lineages::BIGINT AS lineages, joins::BIGINT AS joins FROM r WHERE width IS NOT NULL")
def w04_coalescent_intervals(nodes):
    return trees.coalescent_intervals(nodes).select("tree", r6("height").alias("height"), r6("width").alias("width"), F.col("lineages").cast("long").alias("lineages"), F.col("joins").cast("long").alias("joins"))


@query("trace", f"WITH {TRACE_TAIL}, o AS (SELECT var, value, row_number() OVER (PARTITION BY var ORDER BY value, sample) AS i, count(*) OVER (PARTITION BY var) AS n FROM t), w AS (SELECT a.var, a.i, a.value AS lo, b.value AS hi FROM o a JOIN o b ON a.var = b.var AND b.i = a.i + floor(0.95 * a.n + 0.5) - 1), b AS (SELECT *, row_number() OVER (PARTITION BY var ORDER BY hi - lo, i) AS k FROM w) SELECT var, round(lo, 6) AS hpd_low, round(hi, 6) AS hpd_high FROM b WHERE k = 1")
def a25_hpd(trace):
    return summaries.hpd(summaries.after_burn_in(trace, 0.1, ["var"]), ["var"]).select("var", r6("hpd_low").alias("hpd_low"), r6("hpd_high").alias("hpd_high"))


@query("trace", "SELECT var, round(min(value), 6) AS low, round(max(value), 6) AS high FROM trace GROUP BY var")
def a24_range(trace):
    return summaries.value_range(trace, ["var"]).select("var", r6("low").alias("low"), r6("high").alias("high"))


@query("gt_trace", "WITH c AS (SELECT site, genotype, count(*) AS n FROM gt_trace GROUP BY site, genotype), r AS (SELECT *, rank() OVER (PARTITION BY site ORDER BY n DESC) AS k, sum(n) OVER (PARTITION BY site) AS t FROM c) SELECT site, string_agg(genotype, '+' ORDER BY genotype) AS mode, round(sum(n / t), 6) AS mode_share FROM r WHERE k = 1 GROUP BY site")
def a26_discrete_mode(gt):
    return summaries.discrete_mode(gt, ["site"], "genotype").withColumn("mode_share", r6("mode_share"))


@query("gt_trace", "WITH c AS (SELECT site, genotype, count(*) AS n FROM gt_trace GROUP BY site, genotype), r AS (SELECT *, n / sum(n) OVER (PARTITION BY site) AS s FROM c) SELECT site, string_agg(genotype, ',' ORDER BY genotype) AS value_set, string_agg(printf('%.4f', round(s + 1e-12, 4)), ',' ORDER BY genotype) AS share_set FROM r GROUP BY site")
def a27_frequency_set(gt):
    return summaries.frequency_set(gt, ["site"], "genotype")


@query("events", "WITH p AS (SELECT event_type, value AS x, (event_id % 97)::DOUBLE AS y FROM events), e AS (SELECT event_type, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p GROUP BY event_type), g AS (SELECT event_type, least(floor((x - lx) / greatest(hx - lx, 1e-300) * 40), 39) AS i, least(floor((y - ly) / greatest(hy - ly, 1e-300) * 40), 39) AS j, count(*) AS n FROM p JOIN e USING (event_type) GROUP BY ALL), o AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY n DESC, i, j) - n AS held, sum(n) OVER (PARTITION BY event_type) AS total FROM g) SELECT event_type, min(n) AS level, count(*) AS cells FROM o WHERE held < 0.95::DOUBLE * total GROUP BY event_type")
def a28_hpd_area(events):
    paired = events.select("event_type", F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    return summaries.hpd_area_2d(paired, ["event_type"], "x", "y")


DENSITY_SQL = f"""WITH p AS (SELECT event_type, value AS x, (event_id % 97)::DOUBLE AS y FROM events),
    s AS (SELECT event_type, count(*) AS n, stddev_samp(x) * pow(count(*), -1 / 6.0) AS wx, stddev_samp(y) * pow(count(*), -1 / 6.0) AS wy, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p GROUP BY event_type),
    g AS (SELECT *, lx - 3 * wx AS x0, (hx - lx + 6 * wx) / {contours.GRID - 1} AS dx, ly - 3 * wy AS y0, (hy - ly + 6 * wy) / {contours.GRID - 1} AS dy FROM s),
    c AS (SELECT event_type, floor((x - x0) / dx + 0.5)::INT AS i, floor((y - y0) / dy + 0.5)::INT AS j, count(*) AS m FROM p JOIN g USING (event_type) GROUP BY ALL),
    t AS (SELECT event_type, u.i, j, sum(m * exp(-0.5 * pow((u.i - c.i) * dx / wx, 2)) / (wx * sqrt(2 * pi()))) AS v FROM c JOIN g USING (event_type), range({contours.GRID}) u(i) GROUP BY event_type, u.i, j),
    d AS (SELECT event_type, i, u.j, sum(v * exp(-0.5 * pow((u.j - t.j) * dy / wy, 2)) / (wy * sqrt(2 * pi()))) / any_value(n) AS d FROM t JOIN g USING (event_type), range({contours.GRID}) u(j) GROUP BY event_type, i, u.j),
    r AS (SELECT event_type, d, sum(d) OVER (PARTITION BY event_type ORDER BY d DESC, i, j ROWS UNBOUNDED PRECEDING) - d AS before, sum(d) OVER (PARTITION BY event_type) AS total FROM d)
    SELECT event_type, round(min(d) * 1e6, 4) AS level, count(*) AS cells FROM r WHERE before < 0.9 * total * (1 - 1e-12) GROUP BY event_type"""


@query("events", DENSITY_SQL)
def a28_density_levels(events):
    paired = events.select("event_type", F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    found = contours.density_levels(paired, ["event_type"], "x", "y", 0.9)
    return found.select("event_type", F.round(F.col("level") * 1e6, 4).alias("level"), "cells")


VCF_SQL = """c AS (SELECT s.site, r.cell, s.alt, substr('GTAC', CAST(s.site % 4 AS INT) + 1, 1) AS third, r.r1, r.r2, r.ref_reads, r.cov,
    CASE WHEN k.genotype = 2 AND r.cell % 5 = 0 THEN 3 ELSE k.genotype END AS g,
    list_transform([-r.r1 / 9.0, -r.r2 / 9.0, -r.r3 / 9.0, -r.ref_reads / 9.0], lambda x: floor(-10 / ln(10) * x + 0.5)::BIGINT) AS q,
    list_transform([-r.cov / 7.0, -r.r1 / 3.0], lambda x: floor(-10 / ln(10) * x + 0.5)::BIGINT) AS a
    FROM sites s JOIN reads r USING (site) JOIN calls k USING (site, cell)),
t AS (SELECT site, max(CASE WHEN g = 3 THEN 1 ELSE 0 END) AS two, sum(CASE g WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END)::BIGINT AS a1,
    sum(CASE g WHEN 3 THEN 1 ELSE 0 END)::BIGINT AS a2, 2 * count(*) AS an, sum(cov)::BIGINT AS dp FROM c GROUP BY site),
f AS (SELECT site, cell, cov, concat_ws(':', CASE g WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' ELSE '1/2' END,
    concat_ws(',', ref_reads, r1, CASE WHEN two = 1 THEN r2 END), cov, least(list_sort(list_transform(q, lambda x: x - list_min(q)))[2], 99),
    array_to_string(list_transform(q, lambda x: x - list_min(q)), ','), cell % 2,
    least(list_sort(list_transform(a, lambda x: x - list_min(a)))[2], 99), array_to_string(list_transform(a, lambda x: x - list_min(a)), ',')) AS fields FROM c JOIN t USING (site))"""


def _variant_cells(sites, r, c):
    at = lambda letters: F.substr(F.lit(letters), (F.col("site") % 4 + 1).cast("int"), F.lit(1))
    genotype = F.when((F.col("genotype") == 2) & (F.col("cell") % 5 == 0), 3).otherwise(F.col("genotype")).cast("int")
    met = sites.select("site", F.array("alt").alias("alts"), F.array("alt", at("GTAC")).alias("nucs")).join(r, "site").join(c.select("site", "cell", "genotype"), ["site", "cell"])
    coded = met.withColumn("genotype", genotype).join(F.broadcast(calls.genotype_table(c.sparkSession)), "genotype")  # 4 rows
    below = lambda parts: F.array(*[-F.col(x) / by for x, by in parts])
    liks, ado_liks = below([("r1", 9.0), ("r2", 9.0), ("r3", 9.0), ("ref_reads", 9.0)]), below([("cov", 7.0), ("r1", 3.0)])
    return coded.select("site", "cell", "alts", "alphabet", "ternary", "nucs", F.array("r1", "r2").alias("reads"), "ref_reads", "cov", liks.alias("liks"), ado_liks.alias("ado_liks"), (F.col("cell") % 2).alias("ado"))


@query("sites reads calls", f"WITH {VCF_SQL} SELECT site, CASE WHEN two = 1 THEN concat_ws(',', a1, a2) ELSE a1::VARCHAR END AS ac, an, dp, round(a1 / an, 6) AS first_af FROM t")
def a31_record_totals(sites, r, c):
    totals = calls.record_totals(calls.cell_fields(_variant_cells(sites, r, c)))
    return totals.select("site", F.array_join(F.transform("ac", lambda x: x.cast("string")), ",").alias("ac"), "an", "dp", r6(F.get("af", F.lit(0))).alias("first_af"))


@query("sites reads calls", f"WITH {VCF_SQL} SELECT site, cell, fields FROM f")
def a32_cell_fields(sites, r, c):
    return calls.cell_fields(_variant_cells(sites, r, c)).select("site", "cell", "fields")


@query("sites reads calls", f"""WITH {VCF_SQL}, l AS (SELECT site, string_agg(fields, chr(9) ORDER BY cell) AS cells FROM f GROUP BY site) SELECT chrom, pos, concat_ws(chr(9), chrom, pos, '.', ref, CASE WHEN two = 1 THEN alt || ',' || substr('GTAC', CAST(site % 4 AS INT) + 1, 1) ELSE alt END,
  floor(-10 / ln(10) * (-(site % 90) / 3.0) + 0.5)::BIGINT, 'PASS', 'AC=' || CASE WHEN two = 1 THEN concat_ws(',', a1, a2) ELSE a1::VARCHAR END || ';AF=' || CASE WHEN two = 1 THEN printf('%.3f,%.3f', a1 / an + 1e-9, a2 / an + 1e-9) ELSE printf('%.3f', a1 / an + 1e-9) END || ';AN=' || an || ';DP=' || dp, 'GT:AD:DP:GQ:PL:ADO:ADOQ:ADOP', cells) AS record
  FROM l JOIN t USING (site) JOIN sites USING (site)""")
def k05_vcf_records(sites, r, c):
    return calls.records(_variant_cells(sites, r, c), sites.withColumn("constant", -(F.col("site") % 90) / 3.0))


@query("trace", "WITH m AS (SELECT var, sample % 20 AS config, max(floor(value / 5)) AS posterior FROM trace GROUP BY ALL) SELECT var, config, posterior FROM (SELECT *, rank() OVER (PARTITION BY var ORDER BY posterior DESC) AS k FROM m) WHERE k = 1")
def a35_best_models(trace):
    """For each model all of twenty configurations whose best sample has the largest log posterior."""
    runs = trace.select("var", (F.col("sample") % 20).alias("config"), F.floor(F.col("value") / 5).cast("double").alias("posterior"))
    return summaries.best_configurations(runs, ["var"], "config", "posterior").select("var", "config", "posterior")


PATTERN_C = "c AS (SELECT pattern, count(*) AS weight, -1.0 - length(pattern) / 7.0 AS constant FROM (SELECT site, string_agg(CAST(cov AS VARCHAR), ';' ORDER BY cell) AS pattern FROM pattern_reads GROUP BY site) GROUP BY pattern)"


def _constants(p):
    return reads.patterns(p, ["cov"]).withColumn("constant", -1.0 - F.length("pattern") / 7.0)


@query("pattern_reads", f"WITH {PATTERN_C} SELECT round(sum(constant * weight), 6) AS log_likelihood FROM c")
def a36_weighted_log_likelihood(p):
    return likelihood.weighted_log_likelihood(_constants(p).withColumnRenamed("constant", "log_likelihood")).select(r6("log_likelihood").alias("log_likelihood"))


@query("pattern_reads", f"WITH {PATTERN_C} SELECT round(-sum(weight * ln(1 - exp(constant))), 6) AS correction FROM c")
def a37_lewis_correction(p):
    return likelihood.ascertainment(_constants(p), "lewis").select(r6("correction").alias("correction"))


@query("pattern_reads", f"WITH {PATTERN_C} SELECT round((ln(sum(weight * exp(constant))) - ln(sum(weight))) * 500, 6) AS correction FROM c")
def a38_felsenstein_correction(p):
    return likelihood.ascertainment(_constants(p), "mean", 500.0).select(r6("correction").alias("correction"))


@query("pattern_reads", f"WITH {PATTERN_C} SELECT round(sum(weight * constant) * 500 / sum(weight), 6) AS correction FROM c")
def a38_geometric_correction(p):
    return likelihood.ascertainment(_constants(p), "geometric", 500.0).select(r6("correction").alias("correction"))


@query("background", "SELECT round(sum(occurrences * (lgamma(n_reads + 2.5) - lgamma(2.5))), 4) AS log_likelihood FROM background")
def a40_background_log_likelihood(b):
    n, alpha = F.col("n_reads"), F.lit(2.5)
    return b.agg(F.round(F.sum(F.col("occurrences") * (special.log_gamma(n + alpha) - special.log_gamma(alpha))), 4).alias("log_likelihood"))


@query("background", "SELECT n_reads, round(lgamma(101) - lgamma(n_reads + 1) - lgamma(101 - n_reads) + lgamma(n_reads + 2.0) + lgamma(100 - n_reads + 5.0) - lgamma(107) - (lgamma(2.0) + lgamma(5.0) - lgamma(7.0)), 6) AS log_pmf FROM background")
def f03_beta_binomial(b):
    pmf = distributions.beta_binomial(F.col("n_reads").cast("double"), F.lit(100.0), F.lit(2.0), F.lit(5.0))
    return b.select("n_reads", r6(pmf).alias("log_pmf"))


@query("background", "SELECT n_reads, round(lgamma(3.5 + n_reads) + (3.5 + n_reads) * ln(0.7) - lgamma(n_reads + 1) - lgamma(3.5) - 3.5 * ln(1 / 0.3 - 1), 6) AS log_pmf FROM background")
def f01_negative_binomial(b):
    return b.select("n_reads", r6(distributions.negative_binomial(F.col("n_reads").cast("double"), F.lit(0.3), F.lit(3.5))).alias("log_pmf"))


ALPHAS = (0.4, 0.3, 0.2, 9.1)
DM_SQL = " + ".join(f"CASE WHEN {c} > 0 THEN ln({c}) + lgamma({a}) + lgamma({c}) - lgamma({a} + {c}) ELSE 0 END" for c, a in zip(("r1", "r2", "r3", "ref_reads"), ALPHAS, strict=True))


@query("reads", f"SELECT site, cell, round(CASE WHEN cov = 0 THEN 1.0 ELSE ln(cov) + lgamma(10.0) + lgamma(cov) - lgamma(10.0 + cov) - ({DM_SQL}) END, 4) AS log_pmf FROM reads")
def f02_dirichlet_multinomial(r):
    counts = [F.col(c).cast("double") for c in ("r1", "r2", "r3", "ref_reads")]
    return r.select("site", "cell", F.round(distributions.dirichlet_multinomial(counts, F.col("cov").cast("double"), [F.lit(a) for a in ALPHAS], F.lit(10.0)), 4).alias("log_pmf"))


@query("reads", "SELECT site, cell, round(m / v, 6) AS p, round(m * m / (v - m), 6) AS r FROM (SELECT site, cell, (cell % 3 + 1e-6) * 20.0 * (1 + cell / 10.0) AS m, (cell % 3 + 1e-6) * 20.0 * (1 + cell / 10.0) + (1 + cell / 10.0) * (1 + cell / 10.0) * (cell % 3 + 1e-6) * (cell % 3 + 1e-6) * 30.0 AS v FROM reads)")
def f05_coverage_moments(r):
    p, size = distributions.coverage_moments(F.col("cell") % 3, F.lit(20.0), F.lit(30.0), 1 + F.col("cell") / 10)
    return r.select("site", "cell", r6(p).alias("p"), r6(size).alias("r"))


@query("trace", "SELECT sample, var, floor(-10 / ln(10) * (-value / 7) + 0.5)::BIGINT AS q FROM trace")
def f11_phred(trace):
    return trace.select("sample", "var", special.phred(-F.col("value") / 7, rounded=True).alias("q"))


@query("reads", "WITH s AS (SELECT site, cell, [floor(-10 / ln(10) * -(r1 / 9.0) + 0.5)::BIGINT, floor(-10 / ln(10) * -(r2 / 9.0) + 0.5)::BIGINT, floor(-10 / ln(10) * -(ref_reads / 9.0) + 0.5)::BIGINT] AS q FROM reads) SELECT site, cell, array_to_string(list_transform(q, lambda x: x - list_min(q)), ',') AS pl, least(list_sort(list_transform(q, lambda x: x - list_min(q)))[2], 99) AS gq FROM s")
def f12_phred_likelihoods(r):
    pl, gq = calls.phred_likelihoods(F.array(*[-F.col(c) / 9.0 for c in ("r1", "r2", "ref_reads")]))
    return r.select("site", "cell", F.array_join(pl, ",").alias("pl"), gq.alias("gq"))


def _dm_sql(name: str) -> str:
    alphas, total = distributions.nucleotide_alphas(0.01, 100.0, 2.0)[name]
    terms = " - ".join(f"CASE WHEN {c} > 0 THEN ln({c}) + lgamma({a!r}) + lgamma({c}) - lgamma({a!r} + {c}) ELSE 0 END" for c, a in zip(("r1", "r2", "r3", "ref_reads"), alphas, strict=True))
    return f"CASE WHEN cov = 0 THEN 1.0 ELSE ln(cov) + lgamma({total!r}) + lgamma(cov) - lgamma({total!r} + cov) - {terms} END"


def _nb_sql(k: int) -> str:
    m, s = f"(20.0::DOUBLE * ({k} + 1e-6))", f"(20.0::DOUBLE * ({k} + 1e-6) + 30.0 * ({k} + 1e-6) * ({k} + 1e-6))"
    p, r = f"({m} / {s})", f"({m} * {m} / ({s} - {m}))"
    return f"lgamma({r} + cov) + ({r} + cov) * ln(1 - {p}) - lgamma(cov + 1.0) - lgamma({r}) - {r} * ln(1 / {p} - 1)"


#: (site, cell, lik): each genotype's log likelihood, single dropout of 0.1.
LEAF_SQL = f"""dm AS (SELECT site, cell, {_dm_sql("00")} AS d00, {_dm_sql("01")} AS d01, {_dm_sql("11")} AS d11, {_dm_sql("11x")} AS d11x, {_nb_sql(1)} AS c1, {_nb_sql(2)} AS c2 FROM reads),
    parts AS (SELECT site, cell, [[d00 + c2 + ln(0.9), d00 + c1 + ln(0.1)], [d01 + c2 + ln(0.9), greatest(d00, d11) + ln(1 + exp(-abs(d00 - d11))) + c1 + ln(0.1) - ln(2)],
      [d11 + c2 + ln(0.9), d11 + c1 + ln(0.1)], [d11x + c2 + ln(0.9), d11 + c1 + ln(0.1)]] AS x FROM dm),
    leaf AS MATERIALIZED (SELECT site, cell, list_transform(x, lambda y: greatest(y[1], y[2]) + ln(1 + exp(-abs(y[1] - y[2])))) AS lik FROM parts)"""


@query("reads", f"WITH {LEAF_SQL} SELECT site, cell, round(lik[1], 3) AS g0, round(lik[2], 3) AS g1, round(lik[3], 3) AS g2, round(lik[4], 3) AS g3 FROM leaf")
def f10_mixture_likelihoods(r):
    return _leaf_likelihoods(r).select("site", "cell", *[F.round(F.col("lik")[i], 3).alias(f"g{i}") for i in range(4)])


#: Error, two weights, coverage, raw variance and dropout.
LEAF_MODEL = (0.01, 100.0, 2.0, 20.0, 30.0, 0.1)


def _leaf_components(r, locus_dropout: bool = False):
    return leaves.genotype_likelihoods(r, *LEAF_MODEL, single=not locus_dropout)


#: Components no, single and locus dropout of each genotype, dropout 0.1.
LOCUS_SQL = f"""dm AS (SELECT site, cell, {_dm_sql("00")} AS d00, {_dm_sql("01")} AS d01, {_dm_sql("11")} AS d11, {_dm_sql("11x")} AS d11x, {_nb_sql(0)} AS c0, {_nb_sql(1)} AS c1, {_nb_sql(2)} AS c2 FROM reads),
    one AS (SELECT *, greatest(d00, d11) + ln(1 + exp(-abs(d00 - d11))) AS het FROM dm),
    parts AS (SELECT site, cell, unnest(range(4)) AS g, unnest([[d00 + c2 + 2 * ln(0.9), d00 + c1 + ln(0.9) + ln(0.1) + ln(2), c0 + 2 * ln(0.1)], [d01 + c2 + 2 * ln(0.9), het + c1 + ln(0.9) + ln(0.1), c0 + 2 * ln(0.1)],
      [d11 + c2 + 2 * ln(0.9), d11 + c1 + ln(0.9) + ln(0.1) + ln(2), c0 + 2 * ln(0.1)], [d11x + c2 + 2 * ln(0.9), d11 + c1 + ln(0.9) + ln(0.1) + ln(2), c0 + 2 * ln(0.1)]]) AS x FROM one)"""


@query("reads", f"WITH {LOCUS_SQL} SELECT site, cell, g, round(list_max(x) + ln(list_sum(list_transform(x, lambda y: exp(y - list_max(x))))), 3) AS loglik, list_position(x, list_max(x)) - 1 AS dropped FROM parts")
def f10_locus_dropout(r):
    """Genotype likelihoods where both alleles may drop out, and the most likely number of dropped ones."""
    rows = _leaf_components(r, locus_dropout=True).select("site", "cell", F.posexplode("parts").alias("g", "x"))
    most = F.array_position("x", F.array_max("x")) - 1
    return rows.select("site", "cell", F.col("g").cast("long").alias("g"), F.round(special.log_sum_exp(F.col("x")), 3).alias("loglik"), most.alias("dropped"))


def _leaf_likelihoods(r):
    return _leaf_components(r).select("site", "cell", "lik")


def cell_tree(n: int) -> likelihood.Tree:
    """A binary tree with a trunk over ``n`` cells: neighbours are joined until one node is left."""
    level, parent = list(range(n)), {}
    while len(level) > 1:
        first = n + len(set(parent.values()))
        pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
        above = [first + i if len(p) == 2 else p[0] for i, p in enumerate(pairs)]
        parent |= {c: up for up, p in zip(above, pairs, strict=True) if len(p) == 2 for c in p}
        level = above
    top = n + len(set(parent.values()))
    parent |= {level[0]: top, top: -1}
    return likelihood.Tree(tuple(parent[i] for i in range(top + 1)), (*(0.2 + 0.1 * (i % 4) for i in range(top)), 0.0), n)


def all_cells(r):
    """The tree of all cells of ``r``, and ``r`` with cells numbered as its tips."""
    cells = sorted(x.cell for x in r.select("cell").distinct().collect())  # one row a cell
    tips = F.create_map(*[F.lit(x) for pair in zip(cells, range(len(cells)), strict=True) for x in pair])
    return cell_tree(len(cells)), r.withColumn("cell", tips[F.col("cell")])


def _cell_matrices(tree):
    q = likelihood.rate_matrix(4)
    return [likelihood.transition(q, t) for t in tree.length]


@query("reads")
def t02_tree_log_likelihood(r):
    tree, r = all_cells(r)
    partials = _leaf_likelihoods(r).withColumnRenamed("site", "pattern")
    found = likelihood.pattern_log_likelihoods(partials, tree, [_cell_matrices(tree)], [1.0], [1.0, 0.0, 0.0, 0.0])
    return found.withColumn("log_likelihood", r6("log_likelihood"))


@query("reads")
def t04_best_assignments(r):
    tree, r = all_cells(r)
    partials = _leaf_likelihoods(r).withColumnRenamed("site", "pattern")
    return likelihood.best_assignments(partials, tree, _cell_matrices(tree)).withColumn("log_likelihood", r6("log_likelihood"))


@query("reads", "WITH x AS (SELECT site, cell % 3 AS alleles, cov / (1 + cell / 10.0) AS q, 1 / (1 + cell / 10.0) AS i, cell % 2 + 1 AS weight FROM reads WHERE cov > 0), e AS (SELECT site, weight, alleles, avg(q) AS q, var_samp(q) AS w, avg(i) AS i FROM x GROUP BY site, weight, alleles), c AS (SELECT site, weight, avg(q / (alleles + 1e-6)) AS t, avg(CASE WHEN w - q * i > 0 THEN (w - q * i) / ((alleles + 1e-6) * (alleles + 1e-6)) END) AS v FROM e GROUP BY site, weight) SELECT site, round(sum(weight * t) / sum(weight), 3) AS allelic_cov, round(coalesce(sum(weight * v) / sum(weight) FILTER (v IS NOT NULL), 0), 0) AS raw_var FROM c GROUP BY site")
def a45_allelic_coverage(r):
    rows = r.where("cov > 0").select("site", (F.col("cell") % 2 + 1).alias("weight"), (F.col("cell") % 3).alias("alleles"), "cov", (1 + F.col("cell") / 10).alias("size_factor"))
    return reads.allelic_coverage(rows, ["site"]).select("site", F.round("allelic_cov", 3).alias("allelic_cov"), F.round("raw_var", 0).alias("raw_var"))


@query("sites reads", "WITH x AS (SELECT s.site, r.cell, s.alt, CASE r.cell % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END AS nuc FROM sites s JOIN reads r USING (site) WHERE r.cov > 0), a AS (SELECT site, alt AS nuc, 0 AS turn, 0 AS at_ FROM x UNION SELECT site, nuc, 1, cell FROM x WHERE nuc <> alt), f AS (SELECT site, nuc, turn, min(at_) AS m FROM a GROUP BY site, nuc, turn) SELECT site, nuc, row_number() OVER (PARTITION BY site ORDER BY turn, m, nuc) AS allele FROM f")
def j13_allele_index(sites, r):
    nuc = F.element_at(F.array(*map(F.lit, "ACGT")), (F.col("cell") % 4 + 1).cast("int"))
    rows = sites.join(r.where("cov > 0"), "site").select("site", "cell", F.array("alt").alias("alts"), nuc.alias("nuc"))
    return calls.allele_index(rows).withColumn("allele", F.col("allele").cast("long"))


@query("reads", "SELECT site, nuc, sum(n)::BIGINT AS n_reads, count(DISTINCT cell) AS n_cells FROM (SELECT site, cell, 'A' AS nuc, r1 AS n FROM reads UNION ALL SELECT site, cell, 'C', r2 FROM reads UNION ALL SELECT site, cell, 'G', r3 FROM reads) WHERE n > 0 GROUP BY site, nuc")
def a50_allele_counts(r):
    return calls.allele_columns(r, {"A": "r1", "C": "r2", "G": "r3"})


# Orders and windows


@query("sites", "SELECT site, row_number() OVER (ORDER BY try_cast(substr(chrom, 4) AS INT) NULLS LAST, substr(chrom, 4), pos, upper(alt)) AS site_rank FROM sites")
def o01_site_order(sites):
    return reads.numbered_sites(sites).select("site", F.col("site_rank").cast("long"))


@query("genes", "SELECT gene, start_pos, row_number() OVER (PARTITION BY chrom ORDER BY start_pos, end_pos, upper(gene)) AS place FROM genes")
def o06_gene_order(g):
    return summaries.ranked(g, ["chrom"], ["start_pos", "end_pos", F.upper("gene")], "place").select("gene", "start_pos", F.col("place").cast("long").alias("place"))


@query("gt_trace", "SELECT sample, row_number() OVER (PARTITION BY site, cell ORDER BY sample, genotype, ado) AS place FROM gt_trace")
def o10_sample_order(gt):
    return summaries.ranked(gt, ["site", "cell"], ["sample", "genotype", "ado"], "place").select("sample", F.col("place").cast("long").alias("place"))


@query("reads", "WITH v AS (SELECT site, flatten(list([r1, r2, r3, cov] ORDER BY cell)) AS counts FROM reads GROUP BY site) SELECT site, dense_rank() OVER (ORDER BY counts) AS pattern_id FROM v")
def o11_array_order(r):
    return reads.vector_ids(reads.count_vectors(r, ["r1", "r2", "r3", "cov"]))


@query("pattern_reads", "WITH p AS (SELECT site, string_agg(CAST(cov AS VARCHAR), ';' ORDER BY cell) AS pattern FROM pattern_reads GROUP BY site) SELECT site, dense_rank() OVER (ORDER BY pattern) AS pattern_id FROM p")
def w03_pattern_ids(p):
    return reads.pattern_ids(reads.site_patterns(p, ["cov"]))


@query("sites", "SELECT site, (site * 7) // ((SELECT max(site) FROM sites) + 1) AS part FROM sites")
def w05_site_parts(sites):
    last = sites.agg((F.max("site") + 1).alias("n"))
    return sites.crossJoin(F.broadcast(last)).select("site", F.expr("(site * 7) div n").alias("part"))  # one row


# Sets


@query("calls", "WITH s AS (SELECT site, list_distinct(list(genotype) FILTER (cell < 8)) AS a, list_distinct(list(genotype) FILTER (cell >= 8)) AS b FROM calls GROUP BY site) SELECT site, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS removed, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS added FROM s")
def u01_set_differences(c):
    half = lambda p: F.collect_set(F.when(F.expr(p), F.col("genotype")))
    sets = c.groupBy("site").agg(half("cell < 8").alias("a"), half("cell >= 8").alias("b"))
    text = lambda x: F.array_join(F.sort_array(x), ",")
    return sets.select("site", text(F.array_except("a", "b")).alias("removed"), text(F.array_except("b", "a")).alias("added"))


@clade_query("SELECT c.clade, count(DISTINCT tree) - 1 AS n FROM cl c WHERE clade IN (SELECT clade FROM cl WHERE tree = 0) GROUP BY c.clade")
def u08_without_target(nodes):
    c = trees.clades(nodes)
    own = c.where("tree = 0").select("clade").distinct()
    return trees.clade_credibility(c, 5).join(own, "clade").select("clade", (F.col("n") - 1).alias("n"))


# Scalars


@query("nodes node_gt", f"SELECT p, c, event, count(*) AS n FROM node_gt k JOIN nodes n ON n.tree = 0 AND n.node = k.node JOIN node_gt u ON u.site = k.site AND u.node = n.parent JOIN ({EVENT_SQL}) e ON e.p = u.genotype AND e.c = k.genotype GROUP BY p, c, event")
def f16_event_table(nodes, gt):
    """How often each change of genotype occurs on the branches, with its event."""
    pairs = genes.branch_pairs(nodes.where("tree = 0"), gt).groupBy("parent_gt", "child_gt").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(F.broadcast(genes.event_table(gt.sparkSession)), ["parent_gt", "child_gt"]).select(F.col("parent_gt").alias("p"), F.col("child_gt").alias("c"), "event", "n")  # 12 events


@query("genes", "SELECT gene, replace(replace(concat('\"', gene, ';', 'x\"'), '\"', ''), ';', '/') AS clean FROM genes")
def f25_clean_gene(g):
    return g.select("gene", genes.clean_gene(F.concat(F.lit('"'), F.col("gene"), F.lit(';x"'))).alias("clean"))
