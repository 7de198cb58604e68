"""Operators on sites and read counts: labels, filters, order, missing data, patterns and normalisation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import geometric_mean
from .lineage import kept
from .ranks import ALL, PLACE, medians, numbered, running, with_key_values

#: Chromosome labels: any prefix, then a number from 1 to 22, X, Y or MT.
LABEL = r"^(.*?)(1[0-9]|2[0-2]|[1-9]|[XYxy]|[Mm][Tt])$"


def chromosome(df: DataFrame, col: str = "chrom") -> DataFrame:
    """Adds ``chrom_prefix``, ``chrom_key`` and ``chrom_num`` (null unless numeric); other labels are an error."""
    key = F.regexp_extract(col, LABEL, 2)
    valid = F.when(key == "", F.raise_error(F.concat(F.lit("Not a chromosome label: "), F.col(col)))).otherwise(key)
    return df.withColumn("chrom_prefix", F.regexp_extract(col, LABEL, 1)).withColumn("chrom_key", valid.cast("string")).withColumn("chrom_num", F.expr("try_cast(chrom_key AS INT)"))


def autosomes(df: DataFrame, ignore_sex: bool = True, col: str = "chrom") -> DataFrame:
    """Drops mitochondrial sites, and those of X and Y if asked."""
    kept = df.where(~F.col(col).rlike("[Mm][Tt]$"))
    return kept.where(~F.col(col).rlike("[XYxy]$")) if ignore_sex else kept


def site_order() -> list[Column]:
    """Numbered chromosomes by number and before the others, then position, then alternatives in upper case."""
    return [F.col("chrom_num").asc_nulls_last(), F.col("chrom_key"), F.col("pos"), F.upper("alt")]


def numbered_sites(df: DataFrame) -> DataFrame:
    """``df`` with ``site_rank``, 1 on. Sites are parted by ranges of position, so a chromosome is as many tasks as it fills."""
    labelled = chromosome(df).withColumn("_alt", F.upper("alt"))
    sizes = labelled.groupBy("chrom_key", "chrom_num").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy(F.col("chrom_num").asc_nulls_last(), "chrom_key")
    offsets = sizes.select("chrom_key", (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    ranked = numbered(labelled, ["chrom_key"], ["pos", "_alt"]).join(F.broadcast(offsets), "chrom_key")  # 25 keys at most
    return ranked.withColumn("site_rank", F.col("_before") + F.col(PLACE)).drop("_before", PLACE, ALL, "_alt")


def acgt(alts: Column) -> Column:
    """Only real nucleotides of an array of alternatives."""
    return F.filter(alts, lambda x: F.upper(x).isin("A", "C", "G", "T"))


def allele_depths(ref_reads: Column, locus_alts: Column, cell_nucs: Column, cell_reads: Column) -> Column:
    """Reads of the reference and of each of the locus' alternatives; the first match counts, none is 0."""
    places = F.transform(cell_nucs, lambda x: F.upper(x))

    def reads(alt: Column) -> Column:
        at = F.array_position(places, F.upper(alt))
        return F.when(at > 0, F.element_at(cell_reads, F.greatest(at, F.lit(1)).cast("int"))).otherwise(0)

    return F.concat(F.array(ref_reads), F.transform(locus_alts, reads))


def excluded(cells: DataFrame, names: DataFrame, col: str = "cell") -> DataFrame:
    """``cells`` without those named."""
    return cells.join(names.select(col).distinct(), col, "left_anti")


def unknown_names(cells: DataFrame, names: DataFrame, col: str = "cell") -> DataFrame:
    """Names that are no cell; must be empty before an exclusion is applied."""
    return names.select(col).distinct().join(cells, col, "left_anti")


def known_names(cells: DataFrame, names: DataFrame, col: str = "cell") -> DataFrame:
    """The distinct ``names``; one that is no cell is an error."""
    met = names.select(col).distinct().join(cells.select(col).distinct().withColumn("known", F.lit(True)), col, "left")
    unknown = F.raise_error(F.concat(F.lit("Not a cell: "), F.col(col).cast("string"))).cast(names.schema[col].dataType)
    return met.select(F.when(F.col("known"), F.col(col)).otherwise(unknown).alias(col))


def taxon_places(taxa: DataFrame) -> DataFrame:
    """(taxon, place): distinct names, bare of quotes, with their places from 0 in order; a repeated name is an error."""
    bare = taxa.select(F.regexp_replace("taxon", "^[\"']|[\"']$", "").alias("taxon"))
    twice = bare.groupBy("taxon").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"Repeated name {twice[0].taxon}")
    return numbered(bare, [], ["taxon"]).select("taxon", (F.col(PLACE) - 1).cast("long").alias("place"))


def matched_taxa(rows: DataFrame, places: DataFrame, col: str = "name") -> DataFrame:
    """``rows`` with the ``place`` of their name, quoted or not; a name that isn't among the taxa is an error."""
    bare = F.regexp_replace(col, "^[\"']|[\"']$", "")
    met = rows.withColumn("_bare", bare).join(places.withColumnRenamed("taxon", "_bare"), "_bare", "left")
    unknown = F.raise_error(F.concat(F.lit("Not a taxon: "), F.col(col))).cast("long")
    return met.withColumn("place", F.coalesce("place", unknown)).drop("_bare")


# The names of background histograms in their order, of full counts and of coverage with support.
BACKGROUND_NAMES = {True: ["variant1", "variant2", "variant3", "coverage"], False: ["variant1", "coverage"]}


def ordered_background(rows: DataFrame, full: bool) -> DataFrame:
    """``rows`` (name, ...) with ``place``, that of the name in its kind of data; an unknown name is an error."""
    names = BACKGROUND_NAMES[full]
    place = F.array_position(F.array(*map(F.lit, names)), F.col("name")) - 1
    return rows.withColumn("place", F.when(place >= 0, place.cast("int")).otherwise(F.raise_error(F.concat(F.lit("Not a background: "), F.col("name"))).cast("int")))


def first_cells(rows: DataFrame, n: int) -> DataFrame:
    """The rows of the first ``n`` cells in order."""
    return rows.join(rows.select("cell").distinct().orderBy("cell").limit(n), "cell", "left_semi")


def zero_coverage(rows: DataFrame, mode: int) -> DataFrame:
    """``rows`` with coverages as they are (mode 0), or with one added to each (mode 1), so that none is zero."""
    if mode not in (0, 1):
        raise ValueError(f"No such mode: {mode}")
    return rows.withColumn("cov", F.col("cov") + mode)


def missing_per_site(reads: DataFrame) -> DataFrame:
    """(site, n_missing, n_entries)."""
    return reads.groupBy("site").agg(F.count_if(F.col("cov") == 0).alias("n_missing"), F.count(F.lit(1)).alias("n_entries"))


def below_missing(reads: DataFrame, most: float) -> DataFrame:
    """Sites left after removing those with most missing cells until the missing share is at most ``most``.

    The order is missing cells downwards, then site. Nothing goes if the share is met at first. Running totals
    are taken over groups of equal counts first (at most one group for each possible count), then over ranges of sites
    inside them, so a count that most sites have is spread over tasks as well.
    """
    sites = missing_per_site(reads)
    groups = sites.groupBy("n_missing").agg(F.sum("n_entries").alias("entries"), F.sum("n_missing").alias("missing"))
    downward = Window.orderBy(F.desc("n_missing"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = groups.select(
        "n_missing",
        (F.sum("entries").over(whole) - F.sum("entries").over(downward) + F.col("entries")).alias("entries_left"),
        (F.sum("missing").over(whole) - F.sum("missing").over(downward) + F.col("missing")).alias("missing_left"),
        F.sum("entries").over(whole).alias("all_entries"),
        F.sum("missing").over(whole).alias("all_missing"),
    )
    run = running(sites.withColumn("missing", F.col("n_missing")), ["n_missing"], ["site"], ["n_entries", "missing"])
    run = with_key_values(run, groups, ["n_missing"])
    run = run.withColumn("e", F.col("entries_left") - F.col("_before_n_entries")).withColumn("m", F.col("missing_left") - F.col("_before_missing"))
    # e and m are what is left before this site goes; a site stays from the first place on where the share is met
    return run.where((F.col("all_missing") <= most * F.col("all_entries")) | (F.col("m") <= most * F.col("e"))).select("site", "n_missing")


def site_ranges(spec: str, last: int, ix: Column) -> Column:
    """The predicate of a selection such as ``1-100\\3,7,5:50:9`` on a 1-based index."""
    number = lambda s, d: int(s) if re.fullmatch(r"\d+", s.strip()) else d
    chosen = F.lit(False)
    for part in spec.split(","):
        if "-" in part:
            bounds, _, every = part.partition("\\")
            low, high = bounds.split("-")[:2]
            a, b, step = number(low, 1), number(high, last), number(every, 1)
        elif part.count(":") == 2:
            low, high, every = part.split(":")
            a, b, step = number(low, 1), number(high, last), number(every, 1)
        elif re.fullmatch(r"\s*\d*\s*", part):
            a = b = number(part, 1)
            step = 1
        else:
            raise ValueError(f"Not a selection of sites: {part!r}")
        chosen = chosen | (ix.between(a, b) & ((ix - a) % step == 0))
    return chosen


def site_patterns(reads: DataFrame, values: list[str]) -> DataFrame:
    """(site, pattern): each site's counts in cell order, as one string."""
    entry = F.concat_ws(":", *[F.col(v).cast("string") for v in values])
    cells = F.array_sort(F.collect_list(F.struct("cell", entry.alias("x"))))
    return reads.groupBy("site").agg(F.array_join(F.transform(cells, lambda c: c["x"]), ";").alias("pattern"))


def patterns(reads: DataFrame, values: list[str]) -> DataFrame:
    """(pattern, weight): distinct site columns with their multiplicity."""
    return site_patterns(reads, values).groupBy("pattern").agg(F.count(F.lit(1)).alias("weight"))


def size_factors(reads: DataFrame, zero_counts: bool = False) -> DataFrame:
    """(cell, size_factor): the median over sites of coverage over the site's geometric mean coverage."""
    geo = reads.groupBy("site").agg(geometric_mean(F.col("cov")).alias("geo"))
    ratios = reads.join(geo, "site").where("geo > 0" if zero_counts else "cov > 0 AND geo > 0")
    ratios = ratios.select("cell", (F.col("cov") / F.col("geo")).alias("ratio"))
    return medians(ratios, ["cell"], "ratio").select("cell", F.col("median").alias("size_factor"))


def start_values(reads: DataFrame) -> DataFrame:
    """One row: start coverage (mean / 2), start variance (sample variance / 4), percentage of missing entries."""
    return reads.agg(
        (F.avg("cov") / 2).alias("start_cov"),
        (F.var_samp("cov") / 4).alias("start_var"),
        (100 * F.count_if(F.col("cov") == 0) / F.count(F.lit(1))).alias("pct_missing"),
    )


def allelic_coverage(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, allelic_cov, raw_var) from rows (keys, weight, alleles, cov, size_factor).

    Cells are grouped by number of sequenced alleles. A group's mean of cov / size factor over the alleles gives the
    coverage; its variance less the mean's Poisson part, where positive, gives the raw variance.
    """
    q = F.col("cov") / F.col("size_factor")
    each = cells.groupBy(*keys, "weight", "alleles").agg(F.avg(q).alias("q"), F.var_samp(q).alias("w"), F.avg(1 / F.col("size_factor")).alias("inverse"))
    k = F.col("alleles") + 1e-6
    z = F.when(F.col("w") - F.col("q") * F.col("inverse") > 0, F.col("w") - F.col("q") * F.col("inverse"))
    combo = each.groupBy(*keys, "weight").agg(F.avg(F.col("q") / k).alias("t"), F.avg(z / (k * k)).alias("v"))
    return combo.groupBy(*keys).agg(
        (F.sum(F.col("weight") * F.col("t")) / F.sum("weight")).alias("allelic_cov"),
        F.coalesce(F.sum(F.col("weight") * F.col("v")) / F.sum(F.when(F.col("v").isNotNull(), F.col("weight"))), F.lit(0.0)).alias("raw_var"),
    )


def background_totals(background: DataFrame, n_cells: int) -> DataFrame:
    """(name, n_points, n_sites): points and, where they divide by the cells, sites."""
    return background.groupBy("name").agg(F.sum("occurrences").alias("n_points")).withColumn("n_sites", F.when(F.col("n_points") % n_cells == 0, F.expr(f"n_points div {n_cells}")))


def array_key(counts: Column) -> Column:
    """A binary key that orders arrays of whole numbers as the arrays are ordered, number by number, the shorter first."""
    flipped = F.transform(counts, lambda x: F.lpad(F.hex(x.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.unhex(F.array_join(flipped, ""))


def columns(reads: DataFrame, values: list[str]) -> DataFrame:
    """(site, counts): each site's values in cell order, as one array."""
    cells = F.array_sort(F.collect_list(F.struct("cell", F.array(*[F.col(v).cast("long") for v in values]).alias("x"))))
    return reads.groupBy("site").agg(F.flatten(F.transform(cells, lambda c: c["x"])).alias("counts"))


def count_vectors(reads: DataFrame, values: list[str]) -> DataFrame:
    """(site, counts): each site's counts in cell order, as one array. Sites with unlike numbers of cells are an error."""
    found = columns(reads, values)
    sizes = found.agg(F.min(F.size("counts")).alias("least"), F.max(F.size("counts")).alias("most")).first()
    if sizes.least != sizes.most:
        raise ValueError(f"Arrays of {sizes.least} to {sizes.most} numbers have no order")
    return found


def vector_ids(vectors: DataFrame) -> DataFrame:
    """(site, pattern_id): 1, 2, ... over the distinct vectors of (site, counts) in their numeric order."""
    return pattern_ids(vectors.select("site", array_key(F.col("counts")).alias("pattern")))


def pattern_ids(patterns: DataFrame) -> DataFrame:
    """(site, pattern_id): 1, 2, ... over the distinct patterns of (site, pattern) in their order.

    Distinct patterns are parted by ranges and numbered in each part after those of the parts before, so no task sees
    them all; only the parts' counts meet.
    """
    parted = patterns.select("pattern").distinct().repartitionByRange("pattern")
    distinct = kept(parted.select("pattern", F.spark_partition_id().alias("part")))
    counts = distinct.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each part
    numbered = distinct.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("pattern"))).join(before, "part")
    return patterns.join(numbered.select("pattern", (F.col("before") + F.col("place")).alias("pattern_id")), "pattern").select("site", "pattern_id")
