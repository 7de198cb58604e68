"""Queries of the text formats: each writes a file from the test tables and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import consensus
from ..operators.lineage import shared_folder
from ..sinks import text as sinks
from ..sources import newick
from ..sources import text as sources
from ..streaming import samples
from .catalog import query, r6


def put(*parts: DataFrame) -> str:
    """The path of a new text file with the lines of each part (place, value), in order of part and place."""
    spark = parts[0].sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.txt"
    rows = None
    for i, part in enumerate(parts):
        own = part.select(F.lit(i).alias("part"), F.col("place").cast("long").alias("place"), "value")
        rows = own if rows is None else rows.unionByName(own)
    sinks.write_lines(rows.orderBy("part", "place").select("value"), path)
    return path


def line(spark, *values: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "place long, value string")


def rows_of(df: DataFrame, value: Column, place: str) -> DataFrame:
    return df.select(F.col(place).alias("place"), value.alias("value"))


def joined(df: DataFrame, keys: list[str], order: str, value: Column, sep: str) -> DataFrame:
    """(keys, text): ``value`` of each row in the order of ``order``, parted by ``sep``."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["v"]), sep).alias("text"))


def texts(*columns) -> list[Column]:
    return [F.col(c).cast("string") if isinstance(c, str) else c for c in columns]


@query("cells", "SELECT concat('cell', cell) AS cell FROM cells")
def s01_cell_names(cells):
    named = joined(cells, [(F.col("cell") % 3).alias("k")], "cell", F.concat(F.lit("cell"), F.col("cell").cast("string")), " \t")
    return sources.cell_names(cells.sparkSession, put(rows_of(named, F.concat(F.lit(" "), "text"), "k")))


@query("cells", "SELECT concat('cell', cell) AS cell FROM cells WHERE cell % 3 = 1")
def s02_tumour_cell_names(cells):
    tag = F.when(F.col("cell") % 3 == 1, "CT").otherwise("CN")
    value = F.concat(F.lit("dir.x/cell"), F.col("cell").cast("string"), F.lit(".sorted.bam\t"), tag)
    return sources.tumour_cell_names(cells.sparkSession, put(rows_of(cells, value, "cell")))


def read_count_file(sites, r, supports: bool) -> str:
    """A file of all sites' read counts in the sectioned format."""
    spark = r.sparkSession
    if supports:
        cell = F.concat_ws("\t", *texts("cov", "r1"))
    else:
        cell = F.concat(F.lit("A,C,G;"), F.concat_ws(",", *texts("r1", "r2", "r3", "cov")))
    cells = joined(r, ["site"], "cell", cell, "\t").join(sites, "site")
    body = rows_of(cells, F.concat_ws("\t", *texts("chrom", "pos", "ref", "alt", "text")), "site")
    n = r.agg(F.count_distinct("cell").alias("cells"), F.count_distinct("site").alias("sites")).first()
    return put(line(spark, "=numSamples=", str(n.cells), "=numCandidateMutatedSites=", str(n.sites), "=mutations="), body)


@query("sites reads", "SELECT chrom, pos, alt AS alts, cell, r1, r2, r3, r.ref_reads, cov FROM sites JOIN reads r USING (site)")
def s05_site_reads(sites, r):
    parts = sources.sections(r.sparkSession, read_count_file(sites, r, False))
    found = sources.site_rows(parts["mutations"])
    sources.check_numbers(parts, found.agg(F.max(F.size("cells")).alias("n")).first().n, found.count())
    long = sources.cell_reads(found)
    return long.select("chrom", "pos", F.array_join("alts", ",").alias("alts"), "cell", *[F.get("reads", F.lit(i)).cast("long").alias(f"r{i + 1}") for i in range(3)], F.col("ref_reads").cast("long").alias("ref_reads"), F.col("cov").cast("long").alias("cov"))


@query("sites reads", "SELECT chrom, pos, cell, r1 AS alt_reads, cov - r1 AS ref_reads, cov FROM sites JOIN reads r USING (site)")
def s06_site_supports(sites, r):
    parts = sources.sections(r.sparkSession, read_count_file(sites, r, True))
    long = sources.cell_reads(sources.site_rows(parts["mutations"], True), True)
    return long.select("chrom", "pos", "cell", F.get("reads", F.lit(0)).cast("long").alias("alt_reads"), F.col("ref_reads").cast("long").alias("ref_reads"), F.col("cov").cast("long").alias("cov"))


@query("sites reads background", """WITH h AS (SELECT 1 - n_reads % 2 AS k, sum(occurrences) AS times FROM background GROUP BY n_reads % 2)
    SELECT 'site' AS kind, concat(chrom, ':', pos) AS name, sum(cov)::BIGINT AS n, count(*) AS m FROM sites JOIN reads r USING (site) GROUP BY chrom, pos
    UNION ALL SELECT CASE n_reads % 2 WHEN 0 THEN 'alt1' ELSE 'coverage' END, n_reads::VARCHAR, (occurrences * times * (SELECT count(*) FROM cells))::BIGINT, 1 FROM background JOIN h ON h.k = n_reads % 2""")
def s04_read_counts(sites, r, b):
    """All five sections in one file; each background name is brought to the same number of points."""
    spark = r.sparkSession
    cell = F.concat(F.lit("A,C,G;"), F.concat_ws(",", *texts("r1", "r2", "r3", "cov")))
    cells = joined(r, ["site"], "cell", cell, "\t").join(sites, "site")
    body = rows_of(cells, F.concat_ws("\t", *texts("chrom", "pos", "ref", "alt", "text")), "site")
    n = r.agg(F.count_distinct("cell").alias("cells"), F.count_distinct("site").alias("sites")).first()
    halves = b.groupBy((F.col("n_reads") % 2).alias("k")).agg(F.sum("occurrences").alias("all"))
    other = halves.select((1 - F.col("k")).alias("k"), F.col("all").alias("times"))
    even = b.withColumn("k", F.col("n_reads") % 2).join(other, "k").withColumn("points", F.col("occurrences") * F.col("times") * n.cells)
    points = joined(even, ["k"], "n_reads", F.concat_ws(",", *texts("n_reads", "points")), "\t")
    n_background = even.where("k = 0").agg(F.sum("points")).first()[0] // n.cells
    head = line(spark, "=numSamples=", str(n.cells), "=numCandidateMutatedSites=", str(n.sites), "=numBackgroundSites=", str(n_background), "=mutations=")
    found, background = sources.read_counts(spark, put(head, body, line(spark, "=background="), rows_of(points, F.col("text"), "k")), ["alt1", "coverage"])
    per_site = found.groupBy("chrom", "pos").agg(F.sum("cov").cast("long").alias("n"), F.count(F.lit(1)).alias("m"))
    rows = per_site.select(F.lit("site").alias("kind"), F.concat_ws(":", *texts("chrom", "pos")).alias("name"), "n", "m")
    return rows.unionByName(background.select(F.col("name").alias("kind"), F.col("n_reads").cast("string").alias("name"), F.col("occurrences").alias("n"), F.lit(1).cast("long").alias("m")))


@query("background", "SELECT CASE n_reads % 2 WHEN 0 THEN 'alt1' ELSE 'coverage' END AS name, n_reads, occurrences FROM background")
def s07_background(b):
    pair = F.concat_ws(",", *texts("n_reads", "occurrences"))
    by = joined(b, [(F.col("n_reads") % 2).alias("k")], "n_reads", pair, "\t")
    parts = sources.sections(b.sparkSession, put(line(b.sparkSession, "=background="), rows_of(by, F.col("text"), "k")))
    return sources.background_rows(parts["background"], ["alt1", "coverage"])


@query("reads", "SELECT site AS sample, 'depth' AS var, sum(cov)::DOUBLE AS value FROM reads GROUP BY site UNION ALL SELECT site, 'first', sum(r1) / 4.0 FROM reads GROUP BY site")
def s11_trace_log(r):
    sums = r.groupBy("site").agg(F.sum("cov").alias("a"), (F.sum("r1") / 4.0).alias("b"))
    body = rows_of(sums, F.concat(F.concat_ws("\t", *texts("site", "a", "b")), F.lit("\t")), "site")
    return sources.trace_log(r.sparkSession, put(line(r.sparkSession, "# a comment", "Sample\tdepth\tfirst\t"), body))


@query("reads", "SELECT site AS sample, cell // 4 AS place, cell % 4 AS category, cov::DOUBLE AS cov, r1 / 2.0 AS var FROM reads")
def s12_coverage_samples(r):
    pair = F.concat_ws(",", *texts("cov", F.col("r1").cast("double") / 2))
    places = joined(r, ["site", F.expr("cell div 4").alias("place")], "cell", pair, ";")
    rows = joined(places, ["site"], "place", F.col("text"), "\t")
    body = rows_of(rows, F.concat_ws("\t", *texts("site", "text")), "site")
    found = sources.coverage_samples(r.sparkSession, put(line(r.sparkSession, "Sample\tsites"), body))
    return found.select("sample", F.col("place").cast("long").alias("place"), F.col("category").cast("long").alias("category"), "cov", "var")


@query("sites", "SELECT concat('site', lpad(site::VARCHAR, 7, '0')) AS pseudo, chrom, pos, ref, alt FROM sites")
def s12_site_map(sites):
    headed = sinks.site_headers(sites, 7)
    place = F.substring("pseudo", 5, 20).cast("long")
    found = sources.site_map(sites.sparkSession, put(headed.select(place.alias("place"), "value")))
    return found.select("pseudo", "chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"))


S13_SQL = """WITH long AS (SELECT site, cell % 4 AS category, unnest(['cov', 'var']) AS part, unnest([cov, r1]) AS x FROM reads),
    m AS (SELECT site, category, part, avg(x) AS mean, quantile_cont(x::DOUBLE, 0.5) AS median FROM long GROUP BY ALL),
    k AS (SELECT site, category, part, unnest(['mean', 'median']) AS kind, unnest([mean, median]) AS x FROM m),
    t AS (SELECT var AS name, avg(value) AS mean, quantile_cont(value, 0.5) AS median FROM trace GROUP BY var)
    SELECT chrom || ':' || pos AS name, kind, category, round(max(x) FILTER (part = 'cov'), 6) AS value, round(max(x) FILTER (part = 'var'), 6) AS var FROM k JOIN sites USING (site) GROUP BY ALL
    UNION ALL SELECT name, 'mean', NULL, round(mean, 6), NULL FROM t UNION ALL SELECT name, 'median', NULL, round(median, 6), NULL FROM t"""


@query("trace reads sites", S13_SQL)
def s13_cached_estimates(trace, r, sites):
    """The estimates of a trace and of each site's coverages, written as an estimates file and read back."""
    from ..operators.summaries import estimates, short_estimates

    spark = trace.sparkSession
    kinds = F.explode(F.create_map(F.lit("mean"), "mean", F.lit("median"), "median")).alias("kind", "value")
    own = estimates(trace, ["var"]).select("var", kinds)
    each = short_estimates(r.select("site", (F.col("cell") % 4).alias("category"), "cov", F.col("r1").alias("var")), ["site", "category"], ["cov", "var"])
    both = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_cov").alias("cov"), F.col(f"{k}_var").alias("var")) for k in ("mean", "median")]))
    headers = sinks.site_headers(sites, 9)
    of = F.concat(F.lit("site"), F.lpad(F.col("site").cast("string"), 9, "0")).alias("pseudo")
    coverage = each.select(of, "category", both)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.txt"
    sinks.write_lines(sinks.estimate_lines(own, coverage, headers), path)
    found = sources.cached_estimates(spark, path)
    named = found["coverage"].join(found["sites"], "pseudo").select(F.concat_ws(":", "chrom", F.col("pos").cast("string")).alias("name"), "kind", F.col("category").cast("long").alias("category"), r6("cov").alias("value"), r6("var").alias("var"))
    return named.unionByName(found["estimates"].select(F.col("var").alias("name"), "kind", F.lit(None).cast("long").alias("category"), r6("value").alias("value"), F.lit(None).cast("double").alias("var")))


def streamed(rows, start):
    """What ``start`` has appended to a table from log lines (place, value) that come in two lots of files, after three starts."""
    spark = rows.sparkSession
    folder, table, checkpoint = (f"{shared_folder(spark)}/{uuid.uuid4().hex}" for _ in range(3))
    for lot in (0, 1):
        lines = rows.where(F.col("place") % 2 == lot).select("value")
        lines.repartition(2).write.mode("append").text(folder)
        start(spark, folder, table, checkpoint, 1).awaitTermination()
    start(spark, folder, table, checkpoint, 1).awaitTermination()
    return samples.samples(spark, table)


@query("calls", "SELECT site AS sample, cell // 8 AS place, cell % 8 AS cell, genotype, (cell % 2)::INT AS ado FROM calls")
def k14_genotype_log(c):
    rows = c.select(F.col("site").alias("sample"), F.expr("cell div 8").alias("site"), "cell", "genotype", (F.col("cell") % 2).cast("int").alias("ado"))
    found = streamed(sinks.sampled_line(rows).select(F.col("sample").alias("place"), "value"), samples.genotype_log)
    return found.select("sample", F.col("place").cast("long").alias("place"), F.col("cell").cast("long").alias("cell"), "genotype", "ado")


@query("reads", "SELECT site AS sample, cell // 4 AS place, cell % 4 AS category, cov::DOUBLE AS cov, r1 / 2.0 AS var FROM reads")
def k15_coverage_log(r):
    pair = F.concat_ws(",", *texts("cov", F.col("r1").cast("double") / 2))
    places = joined(r, ["site", F.expr("cell div 4").alias("place")], "cell", pair, ";")
    found = streamed(rows_of(joined(places, ["site"], "place", F.col("text"), "\t"), F.concat_ws("\t", *texts("site", "text")), "site"), samples.coverage_log)
    return found.select("sample", F.col("place").cast("long").alias("place"), F.col("category").cast("long").alias("category"), "cov", "var")


@query("calls", "SELECT site AS sample, 0::BIGINT AS place, cell, genotype, (cell % 2)::INT AS ado FROM calls")
def s14_state_samples(c):
    rows = c.select(F.col("site").alias("sample"), F.lit(0).alias("site"), "cell", "genotype", (F.col("cell") % 2).cast("int").alias("ado"))
    lines = sinks.sampled_line(rows).select(F.col("sample").alias("place"), "value")
    found = sources.state_samples(c.sparkSession, put(line(c.sparkSession, "Sample\tsite0"), lines))
    return found.select("sample", F.col("place").cast("long").alias("place"), F.col("cell").cast("long").alias("cell"), "genotype", "ado")


TREE_SET_SQL = "SELECT n.node AS label, count(*) AS n, round(sum(p.height - n.height), 5) AS length, round(sum(1 + length(n.node) / 4.0), 5) AS rate FROM nodes n JOIN nodes p ON p.tree = n.tree AND p.node = n.parent WHERE n.tree > 0 GROUP BY n.node"


def tree_set(nodes, wrapped: bool):
    """The trees without burn-in, from a Nexus file of them; ``wrapped`` breaks its lines behind each comma and bracket."""
    meta = F.create_map(F.lit("rate"), (1 + F.length("node") / 4.0).cast("string"))
    rows = consensus.with_lengths(nodes).select(F.col("tree").cast("long").alias("tree"), "node", "parent", F.col("node").alias("label"), F.coalesce("length", F.lit(0.0)).alias("length"), meta.alias("meta"))
    texts = newick.to_newick(rows)
    if wrapped:
        texts = texts.withColumn("newick", F.regexp_replace("newick", r"([,(\]])", "$1\n  "))
    path = f"{shared_folder(nodes.sparkSession)}/{uuid.uuid4().hex}.trees"
    sinks.write_lines(newick.nexus(texts), path)
    found = newick.branch_rates(newick.read_trees(nodes.sparkSession, path, 0.2)).where("parent IS NOT NULL")
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("length"), 5).alias("length"), F.round(F.sum("rate"), 5).alias("rate"))


@query("nodes", TREE_SET_SQL)
def s15_tree_set(nodes):
    return tree_set(nodes, wrapped=False)


@query("nodes", TREE_SET_SQL)
def s24_wrapped_trees(nodes):
    return tree_set(nodes, wrapped=True)


@query("sites", "SELECT chrom, pos, ref, concat(alt, ',N') AS alts FROM sites")
def s19_variant_sites(sites):
    found = sources.variant_sites(sites.sparkSession, put(rows_of(sites, F.concat_ws("\t", *texts("chrom", "pos", "ref", F.concat("alt", F.lit(",N")))), "site")))
    return found.select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"))


@query("genes", "SELECT DISTINCT gene FROM genes")
def s20_gene_names(g):
    value = F.concat(F.col("start_pos").cast("string"), F.lit("\t'"), F.col("gene"), F.lit("'"))
    return sources.gene_names(g.sparkSession, put(line(g.sparkSession, "start\tgene"), rows_of(g, value, "start_pos")), 1)


@query("genes", "SELECT chrom, start_pos, end_pos, gene FROM genes")
def s21_annotated_genes(g):
    value = F.concat_ws("\t", *texts("chrom", "start_pos", "end_pos", F.lit("x"), F.concat(F.lit('"'), "gene", F.lit('"'))))
    return sources.annotated_genes(g.sparkSession, put(line(g.sparkSession, "Chr\tStart\tEnd\tRef\tGene.refGene"), rows_of(g, value, "start_pos")))


@query("genes", "SELECT chrom, start_pos, end_pos, gene FROM genes")
def s22_gene_map(g):
    value = F.concat_ws("  ", *texts("chrom", "start_pos", "end_pos", "gene"))
    return sources.gene_map(g.sparkSession, put(line(g.sparkSession, "# chrom start end gene"), rows_of(g, value, "start_pos")))


@query("reads", "WITH g AS (SELECT site, exp(avg(ln(cov))) AS geo FROM reads WHERE cov > 0 GROUP BY site) SELECT cell, round(quantile_cont(cov / geo, 0.5), 6) AS size_factor FROM reads JOIN g USING (site) WHERE cov > 0 GROUP BY cell")
def k08_size_factors(r):
    from ..operators import reads

    path = f"{shared_folder(r.sparkSession)}/{uuid.uuid4().hex}.txt"
    sinks.write_lines(sinks.size_factor_lines(reads.size_factors(r)), path)
    t = F.split("value", "\t")
    return r.sparkSession.read.text(path).select(F.get(t, F.lit(0)).cast("long").alias("cell"), r6(F.get(t, F.lit(1)).cast("double")).alias("size_factor"))
