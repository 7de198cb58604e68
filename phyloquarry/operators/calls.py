"""Variant calls: genotypes, qualities and VCF records from likelihoods and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import log_sum_exp, phred
from .messages import vcf_genotype

#: Genotypes by index: alphabet form, ternary code, alternative alleles.
GENOTYPES = [(0, "0/0", 0, 0), (1, "0/1", 1, 1), (2, "1/1", 2, 2), (3, "1/2", 2, 2)]


def genotype_table(spark) -> DataFrame:
    return spark.createDataFrame([(*g, g[0] != 0) for g in GENOTYPES], "genotype int, alphabet string, ternary int, n_alt int, is_variant boolean")


def phred_likelihoods(log_likelihoods: Column) -> tuple[Column, Column]:
    """(PL, GQ): rounded Phred scores less the smallest, and the second smallest of them, 99 at most."""
    scores = F.transform(log_likelihoods, lambda x: phred(x, rounded=True))
    pl = F.transform(scores, lambda x: x - F.array_min(scores))
    return pl, F.least(F.element_at(F.array_sort(pl), 2), F.lit(99))


def genotype_probabilities(log_likelihoods: Column) -> Column:
    """Normalised probabilities with three decimals, joined by commas."""
    total = log_sum_exp(log_likelihoods)
    return F.array_join(F.transform(log_likelihoods, lambda x: F.format_string("%.3f", F.exp(x - total))), ",")


def consensus_sites(calls: DataFrame, least: int) -> DataFrame:
    """Sites at which at least ``least`` cells are variant."""
    return calls.groupBy("site").agg(F.count_if(F.col("genotype") != 0).alias("n_variant")).where(F.col("n_variant") >= least)


def ambiguous(calls: DataFrame, keep_all: bool = False) -> DataFrame:
    """The first of equally likely calls of a cell, or all of them."""
    if keep_all:
        return calls
    first = Window.partitionBy("site", "cell").orderBy("genotype")
    return calls.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


#: The fields of a cell in a record, in order.
FIELDS = "GT:AD:DP:GQ:PL:ADO:ADOQ:ADOP"


def site_alternatives(cells: DataFrame) -> DataFrame:
    """(site, alts): the site's alternatives, then those that cells' genotypes bring, in the order of the cells."""
    uses = lambda digit: F.instr(F.col("alphabet"), digit) > 0
    own = F.filter(F.array(F.when(uses("1"), F.get("nucs", F.lit(0))), F.when(uses("2"), F.get("nucs", F.lit(1)))), lambda x: x.isNotNull() & (x != "N"))
    brought = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cell", own.alias("own")))), lambda x: x["own"]))
    return cells.groupBy("site").agg(F.array_distinct(F.concat(F.first("alts"), brought)).alias("alts"))


#: What is taken of a cell for its fields.
CELL = ["cell", "alphabet", "nucs", "reads", "ref_reads", "cov", "liks", "ado_liks", "ado"]


def _met(cells: DataFrame) -> DataFrame:
    """(site, alts, cells): a site's rows of ``cells`` in one, in cell order."""
    return cells.groupBy("site").agg(F.first("alts").alias("alts"), F.array_sort(F.collect_list(F.struct(*CELL))).alias("cells"))


def _fielded(met: DataFrame) -> DataFrame:
    """``met`` (site, alts, cells, ..) with all alternatives as ``alts``, and (cell, gt, cov, fields) as ``cells``.

    Each step gives arrays that the next one reads, so that no score is found more than once.
    """
    uses = lambda c, digit, i: F.when(F.instr(c["alphabet"], digit) > 0, F.get(c["nucs"], F.lit(i)))
    brought = F.filter(F.flatten(F.transform("cells", lambda c: F.array(uses(c, "1", 0), uses(c, "2", 1)))), lambda x: x.isNotNull() & (x != "N"))
    alts = met.withColumn("alts", F.array_distinct(F.concat("alts", brought)))
    placed = alts.withColumn("_of", F.map_from_entries(F.transform("alts", lambda x, i: F.struct(x, i + 1))))
    depth = lambda c, alt: F.coalesce(F.get(c["reads"], F.array_position(c["nucs"], alt).cast("int") - 1), F.lit(0)).cast("long")

    def scored(c: Column) -> Column:
        ad = F.concat(F.array(c["ref_reads"].cast("long")), F.transform("alts", lambda x: depth(c, x)))
        scores = [F.transform(c[x], lambda y: phred(y, rounded=True)).alias(x) for x in ("liks", "ado_liks")]
        return F.struct(c["cell"].alias("cell"), vcf_genotype(c["alphabet"], F.col("_of"), c["nucs"]).alias("gt"), ad.alias("ad"), c["cov"].alias("cov"), c["ado"].alias("ado"), *scores)

    carried = ["cell", "gt", "ad", "cov", "ado"]
    found = placed.withColumn("cells", F.transform("cells", scored)).drop("_of")
    least = lambda c: F.struct(*[c[x].alias(x) for x in [*carried, "liks", "ado_liks"]], *[F.array_min(c[x]).alias(f"least_{x}") for x in ("liks", "ado_liks")])
    found = found.withColumn("cells", F.transform("cells", least))
    above = lambda c, x: F.transform(c[x], lambda y: y - c[f"least_{x}"]).alias(x)
    found = found.withColumn("cells", F.transform("cells", lambda c: F.struct(*[c[x].alias(x) for x in carried], above(c, "liks"), above(c, "ado_liks"))))
    listed = lambda x: F.array_join(x.cast("array<string>"), ",")
    second = lambda x: F.least(F.element_at(F.array_sort(x), 2), F.lit(99))

    def text(c: Column) -> Column:
        parts = [c["gt"], listed(c["ad"]), c["cov"], second(c["liks"]), listed(c["liks"]), c["ado"], second(c["ado_liks"]), listed(c["ado_liks"])]
        return F.struct(c["cell"].alias("cell"), c["gt"].alias("gt"), c["cov"].alias("cov"), F.concat_ws(":", *[x.cast("string") for x in parts]).alias("fields"))

    return found.withColumn("cells", F.transform("cells", text))


def cell_fields(cells: DataFrame) -> DataFrame:
    """(site, cell, alts, gt, cov, fields) from a row for each site and cell.

    ``cells`` has site, cell, ``alts`` (the site's), ``alphabet`` (the genotype in 0, 1, 2), ``nucs`` and ``reads`` (the
    cell's nucleotides in order and their reads), ``ref_reads``, ``cov``, ``liks`` and ``ado_liks`` (log likelihoods of
    genotypes and dropout states) and ``ado`` (the chosen state).
    """
    return _fielded(_met(cells)).select("site", "alts", F.explode("cells").alias("c")).select("site", "c.cell", "alts", "c.gt", "c.cov", "c.fields")


def _totalled(sites: DataFrame) -> DataFrame:
    """(site, alts, cells, an, dp, ac, af, ..) from ``_fielded`` sites: ``cells`` are the fields."""
    each = sites.withColumn("dp", F.aggregate("cells", F.lit(0).cast("long"), lambda n, c: n + c["cov"].cast("long")))
    each = each.withColumn("_g", F.flatten(F.transform("cells", lambda x: F.split(x["gt"], "/")))).withColumn("cells", F.transform("cells", lambda x: x["fields"]))
    each = each.withColumn("ac", F.transform("alts", lambda x, i: F.size(F.filter("_g", lambda y: y == (i + 1).cast("string"))))).withColumn("an", F.size("_g").cast("long"))
    return each.withColumn("af", F.transform("ac", lambda x: x / F.col("an"))).drop("_g")


def record_totals(fields: DataFrame) -> DataFrame:
    """(site, alts, ac, an, dp, af) from ``cell_fields``: ac and af hold a number for each alternative."""
    met = fields.groupBy("site").agg(F.first("alts").alias("alts"), F.collect_list(F.struct("gt", "cov", "fields")).alias("cells"))
    return _totalled(met).select("site", "alts", "ac", "an", "dp", "af")


def records(cells: DataFrame, sites: DataFrame) -> DataFrame:
    """(chrom, pos, record): VCF body lines with the cells' fields in cell order.

    ``sites`` has site, chrom, pos, ref and, if it is known, ``constant``, the log likelihood of no change, from which
    the quality is taken.
    """
    return site_records(_met(cells).join(sites.drop("alts"), "site"))


def site_records(sites: DataFrame) -> DataFrame:
    """``records`` of sites with their cells: a row for each, with ``cells`` (an array of CELL in order), ``alts``, chrom, pos, ref and, if known, constant."""
    lines = _totalled(_fielded(sites))
    listed = lambda c, form: F.array_join(F.transform(c, lambda x: F.format_string(form, x)), ",")
    info = F.concat(F.lit("AC="), listed("ac", "%d"), F.lit(";AF="), listed("af", "%.3f"), F.format_string(";AN=%d;DP=%d", "an", "dp"))
    quality = phred(F.col("constant"), rounded=True).cast("string") if "constant" in sites.columns else F.lit(".")
    fixed = ["chrom", F.col("pos").cast("string"), F.lit("."), "ref", F.array_join("alts", ","), quality, F.lit("PASS"), info, F.lit(FIELDS), F.array_join("cells", "\t")]
    return lines.select("chrom", "pos", F.concat_ws("\t", *fixed).alias("record"))


def allele_index(cells: DataFrame) -> DataFrame:
    """(site, nuc, allele): the VCF index of each alternative, the site's own first, unseen ones as cells bring them.

    ``cells`` has site, cell, alts (the site's), nuc (the cell's). A nucleotide's place is that of the first cell.
    """
    own = cells.select("site", F.posexplode("alts").alias("place", "nuc")).groupBy("site", "nuc").agg(F.min("place").alias("place"))
    brought = cells.groupBy("site", "nuc").agg(F.min("cell").alias("cell")).join(own.select("site", "nuc"), ["site", "nuc"], "left_anti")
    placed = own.select("site", "nuc", F.lit(0).alias("turn"), F.col("place").cast("long").alias("at")).unionByName(brought.select("site", "nuc", F.lit(1).alias("turn"), F.col("cell").cast("long").alias("at")))
    return placed.select("site", "nuc", F.row_number().over(Window.partitionBy("site").orderBy("turn", "at", "nuc")).alias("allele"))


def adapted_genotypes(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(genotypes, alternatives): genotypes in the site's alleles, and the alternatives in order with their counts.

    ``cells`` has site, cell, ``alts`` (the site's alternatives), ``alphabet`` (two alleles of 0, 1, 2 parted by /) and
    ``nucs``, the cell's alternative nucleotides by falling reads. 1 stands for the first and 2 for the second of
    them. Taken cell by cell and allele by allele, a nucleotide that isn't among the site's alternatives joins them at the
    end; so an alternative's number follows from where it is first seen, and no site's cells need to meet. A missing nucleotide (or N)
    is 1 and counts for none. Genotypes are (site, cell, genotype), alternatives (site, nuc, allele, n, n_cells).
    """
    letters = F.posexplode(F.split("alphabet", "/")).alias("k", "letter")
    each = cells.select("site", "cell", "nucs", letters)
    place = F.when(F.col("letter") == "1", 0).when(F.col("letter") == "2", 1)
    bad = F.raise_error(F.concat(F.lit("Not an allele: "), F.col("letter"))).cast("string")
    nuc = F.when(F.col("letter") == "0", F.lit("0")).when(place.isNotNull(), F.upper(F.coalesce(F.get("nucs", place), F.lit("N")))).otherwise(bad)
    alleles = each.select("site", "cell", "k", nuc.alias("nuc"))
    own = cells.select("site", F.posexplode("alts").alias("at", "nuc")).groupBy("site", F.upper("nuc").alias("nuc")).agg(F.min("at").alias("at"))
    seen = alleles.where("nuc NOT IN ('0', 'N')").groupBy("site", "nuc").agg(F.min(F.struct("cell", "k")).alias("first"), F.count(F.lit(1)).alias("n"), F.count_distinct("cell").alias("n_cells"))
    met = own.join(seen, ["site", "nuc"], "full")
    order = Window.partitionBy("site").orderBy(F.col("at").asc_nulls_last(), "first")  # a row for each nucleotide
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    alternatives = met.select("site", "nuc", F.row_number().over(order).alias("allele"), zero("n"), zero("n_cells"))
    shown = alleles.join(alternatives.select("site", "nuc", "allele"), ["site", "nuc"], "left")
    digit = F.when(F.col("nuc") == "0", "0").otherwise(F.coalesce(F.col("allele").cast("string"), F.lit("1")))
    pair = [F.max(F.when(F.col("k") == k, digit)) for k in (0, 1)]
    return shown.groupBy("site", "cell").agg(F.concat_ws("/", *pair).alias("genotype")), alternatives


def allele_counts(cells: DataFrame) -> DataFrame:
    """(site, nuc, n_reads, n_cells) for each alternative with reads."""
    return cells.where("reads > 0").groupBy("site", "nuc").agg(F.sum("reads").alias("n_reads"), F.count_distinct("cell").alias("n_cells"))


def allele_columns(cells: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``allele_counts`` of rows (site, cell, ..) that have the reads of each nucleotide in a column of its own (``columns``).

    No row is multiplied, and a site is one group: its cells, as many as it has in a row, are told apart in it.
    """
    with_reads = lambda c: F.col(c) > 0
    sums = [F.sum(F.when(with_reads(c), F.col(c))).alias(f"_n_{i}") for i, c in enumerate(columns.values())]
    seen = [F.collect_set(F.when(with_reads(c), F.col("cell"))).alias(f"_cells_{i}") for i, c in enumerate(columns.values())]
    each = cells.groupBy("site").agg(*sums, *seen)
    listed = [F.struct(F.lit(nuc).alias("nuc"), F.col(f"_n_{i}").alias("n_reads"), F.size(f"_cells_{i}").cast("long").alias("n_cells")) for i, nuc in enumerate(columns)]
    return each.select("site", F.inline(F.array(*listed))).where("n_reads IS NOT NULL")


def sampled_states(samples: DataFrame, keys: list[str], state: str) -> DataFrame:
    """(keys, state, n, share) of sampled genotypes or dropout states."""
    counts = samples.groupBy(*keys, state).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
