"""Queries of likelihoods over tables of trees, with SQL that climbs the same trees one level a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calling, calls, consensus, forest, leaves, likelihood, reads
from ..operators.lineage import kept
from .catalog import LEAF_MODEL, LEAF_SQL, _leaf_likelihoods, query

#: Rate categories: rates and shares.
RATES, SHARES = [0.5, 1.5], [0.4, 0.6]
Q4 = likelihood.rate_matrix(4)
#: exp(q t) by its series for each branch length and category, as a list by row, in logarithms.
MATRIX_SQL = f"""br AS (SELECT n.tree, n.node, n.parent, p.height - n.height AS len FROM cell_nodes n JOIN cell_nodes p ON p.tree = n.tree AND p.node = n.parent),
    cat(category, rate, share) AS (VALUES {", ".join(f"({i}, {r}::DOUBLE, {s}::DOUBLE)" for i, (r, s) in enumerate(zip(RATES, SHARES, strict=True)))}),
    q AS (SELECT {[float(x) for x in Q4.ravel()]!r}::DOUBLE[] AS q),
    series(len, category, t, k, term, total) AS (
      SELECT DISTINCT len, category, len * rate, 0, [1,0,0,0,0,1,0,0,0,0,1,0,0,0,0,1]::DOUBLE[], [1,0,0,0,0,1,0,0,0,0,1,0,0,0,0,1]::DOUBLE[] FROM br, cat
      UNION ALL SELECT len, category, t, k + 1, nt, list_transform(range(1, 17), lambda i: total[i] + nt[i]) FROM (
        SELECT *, list_transform(range(16), lambda i: (term[(i // 4) * 4 + 1] * q[i % 4 + 1] + term[(i // 4) * 4 + 2] * q[4 + i % 4 + 1]
          + term[(i // 4) * 4 + 3] * q[8 + i % 4 + 1] + term[(i // 4) * 4 + 4] * q[12 + i % 4 + 1]) * t / (k + 1)) AS nt FROM series, q) WHERE k < 40),
    mat AS MATERIALIZED (SELECT len, category, list_transform(total, lambda x: CASE WHEN x > 0 THEN ln(x) ELSE {forest.LEAST!r} END) AS lp FROM series WHERE k = 40),
    step AS MATERIALIZED (SELECT tree, node, parent, category, g, h, lp[g * 4 + h + 1] AS lp FROM br JOIN mat USING (len), (VALUES (0), (1), (2), (3)) a(g), (VALUES (0), (1), (2), (3)) b(h))"""


def climb_sql(name: str, below: str, prefix: str) -> str:
    """One level: messages of the nodes in ``below``, summed over children, for parents whose names begin with ``prefix``."""
    return f"""{name} AS MATERIALIZED (SELECT tree, category, pattern, parent AS node, g AS h, sum(m) AS x, sum(k) AS y FROM (
      SELECT tree, category, pattern, node, parent, g, max(lp + x) + ln(sum(exp(lp + x - mx))) AS m, max(lp + y) + ln(sum(exp(lp + y - my))) AS k
      FROM (SELECT *, max(lp + x) OVER w AS mx, max(lp + y) OVER w AS my FROM {below} JOIN step USING (tree, category, node, h)
        WHERE starts_with(parent, '{prefix}') WINDOW w AS (PARTITION BY tree, category, pattern, node, g)) GROUP BY tree, category, pattern, node, parent, g) GROUP BY tree, category, pattern, parent, g)"""


#: Partials x and those of a constant site y at the root, from the tips' likelihoods ``tips`` (pattern, cell, lik).
CLIMB_SQL = ",\n    ".join(
    [
        MATRIX_SQL,
        f"""l0 AS (SELECT n.tree, category, pattern, n.node, h, lik[h + 1] AS x, CASE WHEN h = 0 THEN lik[1] ELSE {2 * forest.LEAST!r} END AS y
      FROM tips JOIN cell_nodes n ON n.node = concat('c', tips.cell::VARCHAR), cat, (VALUES (0), (1), (2), (3)) b(h))""",
        climb_sql("l1", "l0", "g"),
        climb_sql("l2", "l1", "m"),
        climb_sql("l3", "l2", "trunk"),
        climb_sql("l4", "l3", "root"),
        """ll AS (SELECT tree, pattern, max(v) + ln(sum(exp(v - mv))) AS log_likelihood, max(u) + ln(sum(exp(u - mu))) AS constant FROM (
      SELECT *, max(v) OVER (PARTITION BY tree, pattern) AS mv, max(u) OVER (PARTITION BY tree, pattern) AS mu FROM (
        SELECT tree, pattern, ln(share) + x AS v, ln(share) + y AS u FROM l4 JOIN cat USING (category) WHERE h = 0)) GROUP BY tree, pattern)""",
    ]
)
PATTERN_SQL = """columns_of AS (SELECT site, string_agg(concat_ws(':', r1, r2, r3, ref_reads), ';' ORDER BY cell) AS columns FROM reads GROUP BY site),
    weights AS MATERIALIZED (SELECT min(site) AS pattern, count(*) AS weight FROM columns_of GROUP BY columns),
    tips AS MATERIALIZED (SELECT site AS pattern, cell, lik FROM leaf WHERE site IN (SELECT pattern FROM weights))"""
#: Five trees over all cells.
LIKELIHOOD_SQL = f"WITH RECURSIVE {LEAF_SQL},\n    {PATTERN_SQL},\n    {CLIMB_SQL}"


def _patterns(r):
    """(pattern, weight): the distinct site columns, each known by its first site."""
    columns = reads.site_patterns(r, ["r1", "r2", "r3", "ref_reads"])
    return columns.groupBy("pattern").agg(F.min("site").alias("site"), F.count(F.lit(1)).alias("weight")).select(F.col("site").alias("pattern"), "weight")


def _components(counts):
    """Genotype log likelihoods and their components of rows of COUNTS."""
    parts = leaves.components(counts[:, :4].astype(float), counts[:, 4].astype(float), *LEAF_MODEL, single=True)
    return leaves.totalled(parts), parts


def _branch_table(nodes):
    upper = nodes.select("tree", F.col("node").alias("parent"), F.col("height").alias("top"))
    lengths = nodes.join(upper, ["tree", "parent"], "left").select("tree", "node", "parent", (F.col("top") - F.col("height")).alias("length"), F.col("node").alias("label"))
    return forest.branches(lengths, Q4, RATES)


def _roots(nodes, r):
    r = kept(r)
    weights = kept(_patterns(r))
    rows = r.join(weights.select(F.col("pattern").alias("site")), "site", "left_semi")
    tips = _leaf_likelihoods(rows).select(F.col("site").alias("pattern"), F.concat(F.lit("c"), F.col("cell").cast("string")).alias("label"), "lik")
    return weights, forest.root_partials(tips, _branch_table(nodes))


@query("cell_nodes reads", f"{LIKELIHOOD_SQL} SELECT tree, pattern, round(log_likelihood, 4) AS log_likelihood, round(constant, 4) AS constant FROM ll")
def t07_forest_log_likelihoods(nodes, r):
    _, roots = _roots(nodes, r)
    found = forest.pattern_log_likelihoods(roots, SHARES)
    return found.select("tree", "pattern", F.round("log_likelihood", 4).alias("log_likelihood"), F.round("constant", 4).alias("constant"))


@query("cell_nodes reads background", f"""{LIKELIHOOD_SQL}, b AS (SELECT sum(occurrences) / (SELECT count(*) FROM cells) AS n FROM background WHERE name = 'coverage'),
    t AS (SELECT tree, sum(weight * log_likelihood) AS s, max(constant) + ln(sum(weight * exp(constant - mc))) - ln(sum(weight)) AS c FROM (
      SELECT *, max(constant) OVER (PARTITION BY tree) AS mc FROM ll JOIN weights USING (pattern)) GROUP BY tree)
    SELECT tree, round(s + c * n, 2) AS log_likelihood FROM t, b""")
def m11_tree_log_likelihoods(nodes, r, background):
    weights, roots = _roots(nodes, r)
    n_cells = r.select("cell").distinct().count()
    n_sites = background.where("name = 'coverage'").agg(F.sum("occurrences")).first()[0] / n_cells
    found = forest.tree_log_likelihoods(forest.pattern_log_likelihoods(roots, SHARES), weights, "mean", n_sites)
    return found.select("tree", F.round("log_likelihood", 2).alias("log_likelihood"))


@query("cell_nodes reads", f"{LIKELIHOOD_SQL} SELECT tree, round(sum(weight * log_likelihood) - sum(weight * ln(1 - exp(constant))), 3) AS log_likelihood FROM ll JOIN weights USING (pattern) GROUP BY tree")
def m12_calling_log_likelihood(nodes, r):
    weights, roots = _roots(nodes, r)
    found = forest.tree_log_likelihoods(forest.pattern_log_likelihoods(roots, SHARES), weights, "lewis")
    return found.select("tree", F.round("log_likelihood", 3).alias("log_likelihood"))


@query("cell_nodes reads", f"{LIKELIHOOD_SQL} SELECT tree, pattern, category FROM (SELECT *, rank() OVER (PARTITION BY tree, pattern ORDER BY round(ln(share) + x, 9) DESC) AS k FROM l4 JOIN cat USING (category) WHERE h = 0) WHERE k = 1")
def m14_best_categories(nodes, r):
    _, roots = _roots(nodes, r)
    return forest.best_categories(roots, SHARES)


def peak_sql(name: str, below: str, prefix: str) -> str:
    """One level of the best assignment: the largest message of each node, added over children."""
    return f"""{name} AS MATERIALIZED (SELECT category, pattern, parent AS node, g AS h, sum(m) AS x FROM (
      SELECT category, pattern, node, parent, g, max(lp + x) AS m FROM {below} JOIN step USING (category, node, h) WHERE tree = 0 AND starts_with(parent, '{prefix}') GROUP BY category, pattern, node, parent, g)
      GROUP BY category, pattern, parent, g)"""


def tied_sql() -> str:
    """The best states of each node given its parent's, from the values of the levels."""
    levels = " UNION ALL ".join(f"SELECT category, pattern, node, h, x FROM {v}" for v in ("p0", "p1", "p2", "p3"))
    return f"""tied AS MATERIALIZED (SELECT pattern, category, c.i, p.i AS above, g, h FROM (SELECT *, max(lp + x) OVER (PARTITION BY category, pattern, node, g) AS most
      FROM ({levels}) v JOIN step USING (category, node, h) WHERE tree = 0) s JOIN places c USING (node) JOIN places p ON p.node = s.parent WHERE lp + x >= most - 1e-9)"""


#: The calls of tree 0: best categories, every most likely assignment from the root down, the ones of the largest score, and
#: each cell's likelihoods given its parent's genotype.
CALL_SQL = ",\n    ".join(
    [
        LIKELIHOOD_SQL,
        "top AS MATERIALIZED (SELECT pattern, category, y FROM l4 JOIN cat USING (category) WHERE tree = 0 AND h = 0 QUALIFY rank() OVER (PARTITION BY pattern ORDER BY round(ln(share) + x, 9) DESC) = 1)",
        "p0 AS MATERIALIZED (SELECT category, pattern, node, h, x FROM l0 JOIN top USING (category, pattern) WHERE tree = 0)",
        peak_sql("p1", "p0", "g"),
        peak_sql("p2", "p1", "m"),
        peak_sql("p3", "p2", "trunk"),
        "places AS MATERIALIZED (SELECT node, parent, row_number() OVER (ORDER BY height DESC, node) AS i FROM cell_nodes WHERE tree = 0)",
        tied_sql(),
        """walk(pattern, category, i, states) AS (SELECT pattern, category, 1, [0] FROM top
      UNION ALL SELECT w.pattern, w.category, w.i + 1, list_append(states, h) FROM walk w JOIN tied t ON t.pattern = w.pattern AND t.category = w.category AND t.i = w.i + 1 AND t.g = w.states[t.above])""",
        "whole AS MATERIALIZED (SELECT pattern, category, states FROM walk WHERE i = (SELECT max(i) FROM places))",
        """sums AS MATERIALIZED (SELECT category, pattern, node, h, x FROM (SELECT * FROM l0 UNION ALL SELECT tree, category, pattern, node, h, x, y FROM l1 UNION ALL SELECT tree, category, pattern, node, h, x, y FROM l2
      UNION ALL SELECT tree, category, pattern, node, h, x, y FROM l3 UNION ALL SELECT tree, category, pattern, node, h, x, y FROM l4) WHERE tree = 0)""",
        """scored AS (SELECT pattern, category, states, max(x) + ln(sum(exp(x - mx))) AS score FROM (SELECT w.*, x, max(x) OVER (PARTITION BY w.pattern, w.category, w.states) AS mx
      FROM (SELECT *, unnest(range(1, len(states) + 1)) AS i FROM whole) w JOIN places USING (i) JOIN sums s ON s.category = w.category AND s.pattern = w.pattern AND s.node = places.node AND s.h = w.states[w.i]) GROUP BY pattern, category, states)""",
        "chosen AS MATERIALIZED (SELECT pattern, category, states, row_number() OVER (PARTITION BY pattern ORDER BY category, states) AS option FROM (SELECT *, max(score) OVER (PARTITION BY pattern) AS most FROM scored) WHERE score >= most - 1e-9)",
        "d0 AS MATERIALIZED (SELECT pattern, category, option, c.node, states[c.i] AS h, states[p.i] AS g FROM chosen, places c JOIN places p ON p.node = c.parent WHERE starts_with(c.node, 'c'))",
        "site_of AS (SELECT site, min(site) OVER (PARTITION BY columns) AS pattern FROM columns_of)",
        f"""told AS MATERIALIZED (SELECT s.site, option, r.cell, d0.h AS genotype, list_transform(range(4), lambda i: leaf.lik[i + 1] + lps[i + 1]) AS liks, parts.x[d0.h + 1] AS ado_liks, y AS constant, r.r1, r.r2, r.ref_reads, r.cov
      FROM site_of s JOIN d0 USING (pattern) JOIN top USING (pattern, category) JOIN reads r ON r.site = s.site AND concat('c', r.cell::VARCHAR) = d0.node JOIN leaf ON leaf.site = r.site AND leaf.cell = r.cell
      JOIN parts ON parts.site = r.site AND parts.cell = r.cell JOIN (SELECT tree, category, node, g, list(lp ORDER BY h) AS lps FROM step GROUP BY tree, category, node, g) st ON st.tree = 0 AND st.category = d0.category AND st.node = d0.node AND st.g = d0.g)""",
    ]
)


#: The counts of a cell in a site's column, in order.
COUNTS = ["r1", "r2", "r3", "ref_reads", "cov"]


def _called(nodes, r, *others):
    """Calls of tree 0 for all sites, and the cells: ``calling.called_columns`` of each site, with the columns of ``others`` (site, ..)."""
    cells = sorted(x.cell for x in r.select("cell").distinct().collect())  # one a cell
    own = consensus.with_lengths(nodes.where("tree = 0")).select("node", "parent", "length").collect()  # the nodes of one tree
    tree = calling.tree_of([tuple(x) for x in own], [f"c{c}" for c in cells])
    matrices = [[likelihood.transition(Q4, rate * t) for t in tree.length] for rate in RATES]
    columns = reads.columns(r, COUNTS)
    for other in others:
        columns = columns.join(other, "site")
    return calling.called_columns(columns, len(COUNTS), _components, tree, matrices, SHARES), cells


@query("cell_nodes reads", f"{CALL_SQL} SELECT site, cell, genotype, round(liks[1], 4) AS l0, round(liks[2], 4) AS l1, round(liks[3], 4) AS l2, round(liks[4], 4) AS l3, CASE WHEN ado_liks[2] > ado_liks[1] THEN 1 ELSE 0 END AS ado, round(constant, 4) AS constant FROM told")
def t10_called_cells(nodes, r):
    found, cells = _called(nodes, r)
    each = found.select("site", "liks", "ado", "constant", F.posexplode("genotypes").alias("place", "genotype"))
    liks = [F.round(F.get("liks", F.col("place") * 4 + i), 4).alias(f"l{i}") for i in range(4)]
    cell = F.get(F.array(*[F.lit(c).cast("long") for c in cells]), F.col("place")).alias("cell")
    return each.select("site", cell, "genotype", *liks, F.get("ado", F.col("place")).alias("ado"), F.round("constant", 4).alias("constant"))


PHRED = "floor(-10 / ln(10) * x + 0.5)::BIGINT"


@query("cell_nodes sites reads", f"""{CALL_SQL}, ph AS (SELECT told.*, alt, list_transform(liks, lambda x: {PHRED}) AS q, list_transform(ado_liks, lambda x: {PHRED}) AS a FROM told JOIN sites USING (site)),
    tot AS (SELECT site, option, max(CASE WHEN genotype = 3 THEN 1 ELSE 0 END) AS two, sum(CASE genotype WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END)::BIGINT AS a1, sum(CASE genotype WHEN 3 THEN 1 ELSE 0 END)::BIGINT AS a2, 2 * count(*) AS an, sum(cov)::BIGINT AS dp FROM told GROUP BY site, option),
    f AS (SELECT site, option, cell, constant, concat_ws(':', CASE genotype WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' ELSE '1/2' END, concat_ws(',', ref_reads, r1, CASE WHEN two = 1 THEN r2 END), cov,
      least(list_sort(list_transform(q, lambda x: x - list_min(q)))[2], 99), array_to_string(list_transform(q, lambda x: x - list_min(q)), ','), CASE WHEN ado_liks[2] > ado_liks[1] THEN 1 ELSE 0 END,
      least(list_sort(list_transform(a, lambda x: x - list_min(a)))[2], 99), array_to_string(list_transform(a, lambda x: x - list_min(a)), ',')) AS fields FROM ph JOIN tot USING (site, option)),
    lines AS (SELECT site, option, max(constant) AS x, string_agg(fields, chr(9) ORDER BY cell) AS cells FROM f GROUP BY site, option)
    SELECT chrom, pos, concat_ws(chr(9), chrom, pos, '.', ref, CASE WHEN two = 1 THEN alt || ',' || substr('GTAC', CAST(site % 4 AS INT) + 1, 1) ELSE alt END, {PHRED}, 'PASS', 'AC=' || CASE WHEN two = 1 THEN concat_ws(',', a1, a2) ELSE a1::VARCHAR END ||
      ';AF=' || CASE WHEN two = 1 THEN printf('%.3f,%.3f', a1 / an + 1e-9, a2 / an + 1e-9) ELSE printf('%.3f', a1 / an + 1e-9) END || ';AN=' || an || ';DP=' || dp, 'GT:AD:DP:GQ:PL:ADO:ADOQ:ADOP', cells) AS record
    FROM lines JOIN tot USING (site, option) JOIN sites USING (site)""")
def k05_called_records(nodes, sites, r):
    """VCF lines of a likelihood run, from reads and a tree: a line for each of a site's calls."""
    found, cells = _called(nodes, r, sites)
    third = F.substr(F.lit("GTAC"), (F.col("site") % 4 + 1).cast("int"), F.lit(1))
    named = found.withColumns({"alts": F.array("alt"), "nucs": F.array("alt", third), "_cells": F.array(*[F.lit(c).cast("long") for c in cells]), "_forms": F.array(*[F.lit(g) for _, g, _, _ in calls.GENOTYPES])})

    def cell(g, i):
        n = {c: F.get("counts", i * len(COUNTS) + k) for k, c in enumerate(COUNTS)}
        dropouts = F.size("ado_liks") / F.size("genotypes")
        ado_liks = F.slice("ado_liks", (i * dropouts + 1).cast("int"), dropouts.cast("int"))
        given = {"cell": F.get("_cells", i), "alphabet": F.get("_forms", g), "nucs": F.col("nucs"), "reads": F.array(n["r1"], n["r2"]), "ref_reads": n["ref_reads"], "cov": n["cov"]}
        given |= {"liks": F.slice("liks", i * 4 + 1, F.lit(4)), "ado_liks": ado_liks, "ado": F.get("ado", i)}
        return F.struct(*[given[x].alias(x) for x in calls.CELL])

    return calls.site_records(named.select("site", "chrom", "pos", "ref", "alts", "constant", F.transform("genotypes", cell).alias("cells")))
