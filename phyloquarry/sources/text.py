"""Readers of the text formats: cell names, read counts, traces, sampled states, gene maps.

All read with Spark's text or CSV source; nothing is parsed on the driver but section headings, of which a file has
five. A path may be a file or a folder whose files follow each other by name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder

SECTIONS = ("numSamples", "numCandidateMutatedSites", "numBackgroundSites", "mutations", "background")


HEADING = re.compile(r"^=(\w+)=\s*$")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, line): the lines of a file, or of a folder's files by name, with a value that grows along them."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(place.alias("place"), F.col("value").alias("line"))


def cell_names(spark: SparkSession, path: str) -> DataFrame:
    """(cell): names parted by any white space, many a line."""
    names = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("cell"))
    return names.where("cell <> ''")


def tumour_cell_names(spark: SparkSession, path: str) -> DataFrame:
    """(cell): of two tab-parted columns, rows tagged CT; the last path part up to its first dot. Other widths are an error."""
    row = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t").alias("c"))
    checked = F.when(F.size("c") == 2, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("Not two columns: "), F.array_join("c", " "))).cast("array<string>"))
    return row.select(checked.alias("c")).where("trim(get(c, 1)) = 'CT'").select(F.split_part(F.try_element_at(F.split(F.get("c", F.lit(0)), "/"), F.lit(-1)), F.lit("."), F.lit(1)).alias("cell"))


def sections(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Section name to its lines (place, line); headings look like ``=mutations=``.

    The text is read once and parted by section into a table in the shared folder, so that a section is later one scan of
    its own rows. A split's lines before its first heading belong to the last section that begins in a split before it.
    """

    def parted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict[tuple, str] = {}
        for frame in frames:
            out = []
            for file, block, row, line in zip(frame["file"], frame["block"], frame["row"], frame["line"], strict=True):
                if head := HEADING.match(line):
                    now[file, block] = head[1]
                    out.append((file, block, row, head[1], "heading"))
                elif line.strip():
                    name = now.get((file, block))
                    out.append((file, block, row, line, f"of {name}" if name else "open"))
            yield pd.DataFrame(out, columns=["file", "block", "row", "line", "part"])

    kinds = "file string, block long, row long, line string, part string"
    table = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    lines(spark, path).select("place.*", "line").mapInPandas(parted, kinds).write.partitionBy("part").parquet(table)
    rows = spark.read.schema(kinds).parquet(table)
    heads = rows.where("part = 'heading'").orderBy("file", "block", "row").limit(len(SECTIONS) + 1).collect()
    if len(heads) > len(SECTIONS):
        raise ValueError(f"More than {len(SECTIONS)} sections in {path}")
    split = F.struct("file", "block")
    at = lambda r: F.struct(F.lit(r.file).alias("file"), F.lit(r.block).cast("long").alias("block"))
    found: dict[str, DataFrame] = {}
    for here, after in zip(heads, [*heads[1:], None], strict=True):
        if here.line not in SECTIONS or here.line in found:
            raise ValueError(f"Unknown or repeated section {here.line}")
        later = split > at(here)
        inherited = (F.col("part") == "open") & (later & (split <= at(after)) if after else later)
        own = rows.where((F.col("part") == f"of {here.line}") | inherited)
        found[here.line] = own.select(F.struct("file", "block", "row").alias("place"), "line")
    return found


def read_counts(spark: SparkSession, path: str, names: list[str], supports: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reads, background) of a sectioned file: ``cell_reads`` and ``background_rows``, with every declared number checked.

    Samples and candidate sites must be as many as declared, and each background name must have a point for every
    background site and sample. A section that isn't there declares nothing and has no rows.
    """
    parts = sections(spark, path)
    none = spark.createDataFrame([], "place struct<file:string,block:bigint,row:bigint>, line string")
    sites = site_rows(parts.get("mutations", none), supports)
    sizes = sites.agg(F.coalesce(F.max(F.size("cells")), F.lit(0)).alias("most"), F.coalesce(F.min(F.size("cells")), F.lit(0)).alias("least"), F.count(F.lit(1)).alias("n")).first()
    if sizes.most != sizes.least:
        raise ValueError(f"Sites have {sizes.least} to {sizes.most} cells")
    check_numbers(parts, sizes.most, sizes.n)
    background = background_rows(parts.get("background", none), names, supports)
    if "numBackgroundSites" in parts:
        check_background(background, number(parts["numBackgroundSites"]) * sizes.most)
    return cell_reads(sites, supports), background


def number(section: DataFrame) -> int:
    """The one integer of a section."""
    return int(section.select(F.trim("line").cast("long").alias("n")).first().n)


def check_numbers(parts: dict[str, DataFrame], n_samples: int, n_sites: int) -> None:
    """An error where a file's declared numbers of samples and candidate sites are not those found."""
    for name, found in (("numSamples", n_samples), ("numCandidateMutatedSites", n_sites)):
        if name in parts and (declared := number(parts[name])) != found:
            raise ValueError(f"{name} is {declared}, found {found}")


def check_background(rows: DataFrame, n_points: int) -> None:
    """An error where (name, n_reads, occurrences) repeats a number of reads or doesn't add up to ``n_points`` a name."""
    per = rows.groupBy("name").agg(F.sum("occurrences").alias("n"), F.count(F.lit(1)).alias("rows"), F.count_distinct("n_reads").alias("distinct"))
    bad = per.where(F.col("n").isNull() | (F.col("n") != n_points) | (F.col("rows") != F.col("distinct"))).orderBy("name").limit(1).collect()
    if bad:
        raise ValueError(f"Background of {bad[0].name}: {bad[0].n} points of {n_points}, {bad[0].rows} rows for {bad[0].distinct} numbers of reads")


def site_rows(section: DataFrame, supports: bool = False) -> DataFrame:
    """(place, chrom, pos, ref, alts, cells): ``cells`` are the texts of the cells in order."""
    c = F.split("line", "\t")
    cells = F.slice("c", 5, F.size("c"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.expr("size(cells) div 2"), F.lit(1))), lambda i: F.concat_ws(",", F.get("cells", 2 * i - 2), F.get("cells", 2 * i - 1)))
    rows = section.select("place", c.alias("c")).select("place", F.get("c", F.lit(0)).alias("chrom"), F.get("c", F.lit(1)).cast("long").alias("pos"), F.get("c", F.lit(2)).alias("ref"), F.split(F.get("c", F.lit(3)), ",").alias("alts"), cells.alias("cells"))
    return rows.withColumn("cells", pairs) if supports else rows


def cell_reads(sites: DataFrame, supports: bool = False) -> DataFrame:
    """(chrom, pos, ref, alts, cell, nucs, reads, ref_reads, cov), a row for each site and cell.

    ``n1,n2,n3;r1,r2,r3,cov`` or, for coverage and support, ``cov,alt`` with N for the nucleotide. A cell without
    coverage is missing.
    """
    long = sites.select("chrom", "pos", "ref", "alts", F.posexplode("cells").alias("cell", "x"))
    states = 2 if supports else 4
    t = F.split("x", "[,;]")
    wrong = F.raise_error(F.concat(F.lit(f"Not {states} read states: "), F.col("x"))).cast("array<string>")
    t = F.when(F.size(t) == (2 if supports else 7), t).otherwise(wrong)
    if supports:
        cov, reads, nucs = F.get(t, F.lit(0)).cast("int"), F.array(F.get(t, F.lit(1)).cast("int")), F.array(F.lit("N"))
    else:
        cov, reads, nucs = F.get(t, F.lit(6)).cast("int"), F.transform(F.slice(t, 4, 3), lambda v: v.cast("int")), F.slice(t, 1, 3)
    total = F.aggregate(reads, F.lit(0), lambda s, v: s + v)
    return long.select("chrom", "pos", "ref", "alts", F.col("cell").cast("long").alias("cell"), nucs.alias("nucs"), reads.alias("reads"), (cov - total).alias("ref_reads"), cov.alias("cov"))


def background_rows(section: DataFrame, names: list[str], supports: bool = False) -> DataFrame:
    """(name, n_reads, occurrences) from one line for each name, in order."""
    first = {r.place: n for r, n in zip(section.select("place").orderBy("place").limit(len(names)).collect(), names, strict=False)}
    label = F.coalesce(*[F.when((F.col("place.file") == p.file) & (F.col("place.block") == p.block) & (F.col("place.row") == p.row), F.lit(n)) for p, n in first.items()]) if first else F.lit(None).cast("string")
    t = F.split(F.trim("line"), r"\t")
    if supports:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest((F.size(t) / 2).cast("int"), F.lit(1))), lambda i: F.concat_ws(",", F.get(t, 2 * i - 2), F.get(t, 2 * i - 1)))
    else:
        pairs = t
    long = section.select(label.alias("name"), F.explode(pairs).alias("x")).select("name", F.split("x", ",").alias("p"))
    return long.select("name", F.get("p", F.lit(0)).cast("long").alias("n_reads"), F.get("p", F.lit(1)).cast("long").alias("occurrences"))


def trace_log(spark: SparkSession, path: str) -> DataFrame:
    """(sample, var, value) from a tab-parted log whose header begins with Sample; # comments; ragged rows are an error."""
    head = spark.read.text(path).where(F.col("value").startswith("Sample\t")).first()
    if head is None:
        raise ValueError(f"No header that begins with Sample in {path}")
    names = head.value.rstrip("\t").split("\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & ~F.col("value").startswith("Sample\t") & (F.trim("value") != ""))
    c = F.split(F.rtrim(F.regexp_replace("value", r"\t+$", "")), "\t")
    checked = F.when(F.size(c) == len(names), c).otherwise(F.raise_error(F.concat(F.lit("Ragged row: "), F.col("value"))).cast("array<string>"))
    long = rows.select(checked.alias("c")).select(F.get("c", F.lit(0)).cast("long").alias("sample"), F.posexplode(F.slice("c", 2, len(names))).alias("i", "x"))
    return long.select("sample", F.element_at(F.array(*map(F.lit, names[1:])), F.col("i") + 1).alias("var"), F.col("x").cast("double").alias("value"))


def site_map(spark: SparkSession, path: str) -> DataFrame:
    """(pseudo, chrom, pos, ref, alts) from the ``#site001->chr1,100,A,C`` lines of a log."""
    found = spark.read.text(path).where(F.col("value").rlike(r"^#\S+->")).select(F.split(F.substr("value", F.lit(2), F.length("value")), "->").alias("s"))
    t = F.split(F.get("s", F.lit(1)), ",")
    return found.select(F.get("s", F.lit(0)).alias("pseudo"), F.get(t, F.lit(0)).alias("chrom"), F.get(t, F.lit(1)).cast("long").alias("pos"), F.get(t, F.lit(2)).alias("ref"), F.slice(t, 4, F.size(t)).alias("alts"))


def coverage_rows(lines: DataFrame) -> DataFrame:
    """(sample, place, category, cov, var) of (value) lines: sites by tabs, categories by semicolons, ``cov,var`` in each."""
    rows = lines.where(~F.col("value").startswith("#") & ~F.col("value").startswith("Sample") & (F.trim("value") != ""))
    c = rows.select(F.split(F.rtrim(F.regexp_replace("value", r"\t+$", "")), "\t").alias("c"))
    sites = c.select(F.get("c", F.lit(0)).cast("long").alias("sample"), F.posexplode(F.slice("c", 2, F.size("c"))).alias("place", "x"))
    cats = sites.select("sample", "place", F.posexplode(F.split(F.regexp_replace("x", ";+$", ""), ";")).alias("category", "y"))
    pair = F.split("y", ",")
    return cats.select("sample", "place", "category", F.get(pair, F.lit(0)).cast("double").alias("cov"), F.get(pair, F.lit(1)).cast("double").alias("var"))


def coverage_samples(spark: SparkSession, path: str) -> DataFrame:
    """``coverage_rows`` of a log."""
    return coverage_rows(spark.read.text(path))


def state_rows(lines: DataFrame) -> DataFrame:
    """(sample, place, cell, genotype, ado) of (value) lines: sites by tabs, cells by semicolons, ``genotype,ado`` in each."""
    found = coverage_rows(lines)
    return found.select("sample", "place", F.col("category").alias("cell"), F.col("cov").cast("int").alias("genotype"), F.col("var").cast("int").alias("ado"))


def state_samples(spark: SparkSession, path: str) -> DataFrame:
    """``state_rows`` of a log."""
    return state_rows(spark.read.text(path))


def loci(text: Column) -> Column:
    """An array of (chrom, pos, ref, alts) from ``chr,pos,ref,alt[,alt];...``; fewer than four fields are an error."""

    def one(x: Column) -> Column:
        t = F.split(x, ",")
        return F.struct(
            F.when(F.size(t) >= 4, F.get(t, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("Not a locus: "), x)).cast("string")).alias("chrom"),
            F.get(t, F.lit(1)).cast("long").alias("pos"),
            F.get(t, F.lit(2)).alias("ref"),
            F.slice(t, 4, F.greatest(F.size(t) - 3, F.lit(0))).alias("alts"),
        )

    return F.transform(F.filter(F.split(text, ";"), lambda x: F.trim(x) != ""), one)


def variant_sites(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alts) from a white-space parted list."""
    t = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(t, F.lit(0)).alias("chrom"), F.get(t, F.lit(1)).cast("long").alias("pos"), F.get(t, F.lit(2)).alias("ref"), F.split(F.get(t, F.lit(3)), ",").alias("alts"))


def gene_names(spark: SparkSession, path: str, column: int = 0, sep: str = "\t") -> DataFrame:
    """(gene): distinct names of one column, quotes dropped; the header is skipped."""
    rows = spark.read.csv(path, sep=sep, header=True)
    return rows.select(F.regexp_replace(F.col(f"`{rows.columns[column]}`"), "[\"']", "").alias("gene")).distinct()


def annotated_genes(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(chrom, start_pos, end_pos, gene) from the first three columns and Gene.refGene, in any case."""
    rows = spark.read.csv(path, sep=sep, header=True)
    at = next((c for c in rows.columns if c.lower() == "gene.refgene"), None)
    if at is None:
        raise ValueError("No column Gene.refGene")
    a, b, c = (F.col(f"`{x}`") for x in rows.columns[:3])
    return rows.select(a.alias("chrom"), b.cast("long").alias("start_pos"), c.cast("long").alias("end_pos"), F.regexp_replace(F.col(f"`{at}`"), "[\"']", "").alias("gene"))


def gene_map(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start_pos, end_pos, gene) from four white-space parted fields; # comments."""
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(F.get(t, F.lit(0)).alias("chrom"), F.get(t, F.lit(1)).cast("long").alias("start_pos"), F.get(t, F.lit(2)).cast("long").alias("end_pos"), F.get(t, F.lit(3)).alias("gene"))


def embedded_background(rows: DataFrame, col: str = "background") -> DataFrame:
    """(other columns, n_reads, occurrences) of texts ``reads,occurrences;...``; negative or repeated numbers of reads are errors."""
    keys = [c for c in rows.columns if c != col]
    pair = F.split("pair", ",")
    parts = rows.select(*keys, F.explode(F.split(F.col(col), ";")).alias("pair")).where("trim(pair) <> ''")
    read = parts.select(*keys, F.trim(F.get(pair, F.lit(0))).cast("long").alias("n_reads"), F.trim(F.get(pair, F.lit(1))).cast("long").alias("n"))
    whole = read.groupBy(*keys, "n_reads").agg(F.count(F.lit(1)).alias("times"), F.min("n").alias("least"))
    wrong = (F.col("times") > 1) | (F.col("n_reads") < 0) | F.col("n_reads").isNull() | F.col("least").isNull() | (F.col("least") < 0)
    error = F.raise_error(F.concat(F.lit("Negative, repeated or no number of reads: "), F.coalesce(F.col("n_reads").cast("string"), F.lit("none")))).cast("long")
    return whole.select(*keys, "n_reads", F.when(wrong, error).otherwise(F.col("least")).alias("occurrences"))


def cached_estimates(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``estimates`` (var, kind, value), ``coverage`` (pseudo, kind, category, cov, var) and ``sites`` as of ``site_map``.

    Errors: sites with estimates but no map line, or the other way round; sites with unlike numbers of categories;
    variables or sites with unlike numbers of kinds.
    """
    rows = lines(spark, path)
    head = lambda text: F.min(F.when(F.col("line").startswith(text), F.col("place")))
    at = rows.agg(head("#MCMC").alias("mcmc"), head("#Allelic").alias("allelic")).first()  # two places
    place = lambda x: F.struct(F.lit(x.file).alias("file"), F.lit(x.block).cast("long").alias("block"), F.lit(x.row).cast("long").alias("row"))
    after = lambda x: F.lit(False) if x is None else F.col("place") > place(x)
    data = rows.where(~F.col("line").startswith("#") & ~F.col("line").startswith("id\t") & ~F.col("line").startswith("sites\t") & (F.trim("line") != ""))
    c = F.split("line", "\t")
    data = data.withColumns({f"c{i}": F.get(c, F.lit(i)) for i in range(3)})
    later = after(at.allelic)
    estimates = data.where(~later & after(at.mcmc)).select(F.col("c0").alias("var"), F.col("c1").alias("kind"), F.col("c2").cast("double").alias("value"))
    pair = F.split("x", ",")
    coverage = data.where(later).select(F.col("c0").alias("pseudo"), F.col("c1").alias("kind"), F.posexplode(F.split("c2", ";")).alias("category", "x"))
    coverage = coverage.select("pseudo", "kind", "category", F.get(pair, F.lit(0)).cast("double").alias("cov"), F.get(pair, F.lit(1)).cast("double").alias("var"))
    sites = site_map(spark, path).where(F.col("pseudo").startswith("site"))

    given = data.where(later & F.col("c2").isNotNull()).select(F.col("c0").alias("pseudo"), F.col("c1").alias("kind"), F.size(F.split("c2", ";")).alias("n"), F.lit(False).alias("mapped"))
    mapped = sites.select("pseudo", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("n"), F.lit(True).alias("mapped"))
    both = given.unionByName(mapped).repartition("pseudo")  # dealt once for what follows
    kinds = both.groupBy("pseudo", "kind").agg(F.sum("n").alias("n"), F.bool_or("mapped").alias("mapped"))
    each = kinds.groupBy("pseudo").agg(F.count("kind").alias("kinds"), F.min("n").alias("low"), F.max("n").alias("high"), F.bool_or("mapped").alias("mapped"))
    some = F.col("kinds") > 0
    named = {"No map line for": some & ~F.col("mapped"), "No estimates for": ~some}
    ends = [F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.when(some, F.col("kinds"))).alias("least"), F.max(F.when(some, F.col("kinds"))).alias("most")]
    found = each.agg(*ends, *[F.min(F.when(wrong, F.col("pseudo"))).alias(what) for what, wrong in named.items()]).first()
    for what in named:
        if found[what] is not None:
            raise ValueError(f"{what} {found[what]}")
    if found.low != found.high:
        raise ValueError(f"Unlike numbers of categories: {found.low} to {found.high}")
    own = estimates.groupBy("var").agg(F.count_distinct("kind").alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    numbers = [x for x in (found.least, found.most, own.least, own.most) if x is not None]
    if len(set(numbers)) > 1:
        raise ValueError(f"Unlike numbers of kinds of estimates: {min(numbers)} to {max(numbers)}")
    return {"estimates": estimates, "coverage": coverage, "sites": sites}
