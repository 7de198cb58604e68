"""Writers: VCF, detail files, cell names, estimates and metadata text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of the VCF 4.3 header after file date and source, in the file's order; PL lists the genotypes.
VCF_HEADER = [
    '##FILTER=<ID=LowQual,Description="Low quality">',
    '##INFO=<ID=AC,Number=1,Type=Integer,Description="Allele count in genotypes, for each ALT allele, in the same order as listed">',
    '##INFO=<ID=AF,Number=1,Type=Float,Description="Allele Frequency, for each ALT allele, in the same order as listed">',
    '##INFO=<ID=AN,Number=1,Type=Integer,Description="Total number of alleles in called genotypes">',
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="Approximate read depth; some reads may have been filtered">',
    '##FORMAT=<ID=AD,Number=.,Type=Integer,Description="Allelic depths for the ref and alt alleles in the order listed">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Approximate read depth (reads with MQ=255 or with bad mates are filtered)">',
    '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype quality">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=PL,Number=G,Type=Integer,Description="Normalized, phred-scaled likelihoods for genotypes as defined in the VCF specification; in the following order: {genotypes}">',
    '##FORMAT=<ID=ADO,Number=1,Type=Integer,Description="Allelic dropout (ADO) state corresponding to the number of ADOs.">',
    '##FORMAT=<ID=ADOQ,Number=1,Type=Integer,Description="Allelic dropout quality">',
    '##FORMAT=<ID=ADOP,Number=D,Type=Integer,Description="Normalized, phred-scaled likelihoods for each possible ADO state">',
]
VCF_COLUMNS = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]


def vcf_header(cells: list[str], genotypes: list[str], date: str, source: str) -> list[str]:
    """The header's lines, the column names last."""
    fixed = [x.format(genotypes=",".join(genotypes)) if "{genotypes}" in x else x for x in VCF_HEADER]
    return ["##fileformat=VCFv4.3", f"##fileDate={date}", f"##source={source}", *fixed, "\t".join([*VCF_COLUMNS, *cells])]


def vcf_lines(records: DataFrame, head: list[str], contigs: list[str]) -> DataFrame:
    """(value): header and records (chrom, pos, record) in order; contigs come in the given order."""
    spark = records.sparkSession
    top = spark.createDataFrame([(-1, i, x) for i, x in enumerate(head)], "a int, b bigint, value string")
    place = F.coalesce(*[F.when(F.col("chrom") == c, F.lit(i)) for i, c in enumerate(contigs)], F.lit(len(contigs)))
    body = records.select(place.alias("a"), F.col("pos").cast("long").alias("b"), F.col("record").alias("value"))
    return top.unionByName(body).orderBy("a", "b", "value").select("value")


def write_lines(rows: DataFrame, path: str) -> None:
    """A folder of text files from ordered (value) rows; read by name the files give the rows in order. No task writes all."""
    rows.write.text(path)


def per_site(calls: DataFrame, shown: Column) -> DataFrame:
    """(site, value): a line for each site with the cells' ``shown`` text in cell order, parted by tabs."""
    cells = F.array_sort(F.collect_list(F.struct("cell", shown.alias("x"))))
    return calls.groupBy("site").agg(F.array_join(F.transform(cells, lambda c: c["x"]), "\t").alias("value"))


def loci_info(sites: DataFrame) -> DataFrame:
    """(value): chrom, pos, ref and alternatives, N where none is left."""
    alts = F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise("N")
    return sites.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "ref", alts).alias("value"))


def site_headers(sites: DataFrame, width: int) -> DataFrame:
    """(site, pseudo, value): each site with its zero-padded pseudo name and its map line; longer numbers are cut to ``width``."""
    name = F.concat(F.lit("site"), F.lpad(F.col("site").cast("string"), width, "0"))
    return sites.select("site", name.alias("pseudo"), F.concat(F.lit("#"), name, F.lit("->"), F.concat_ws(",", "chrom", F.col("pos").cast("string"), "ref", "alt")).alias("value"))


def metadata_text(meta: Column) -> Column:
    """``k=v`` pairs by key, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def sampled_line(samples: DataFrame) -> DataFrame:
    """(sample, value): sites by tabs, cells by semicolons, ``genotype,ado`` in each."""
    pair = F.concat_ws(",", F.col("genotype").cast("string"), F.col("ado").cast("string"))
    cells = F.array_sort(F.collect_list(F.struct("cell", pair.alias("x"))))
    sites = samples.groupBy("sample", "site").agg(F.array_join(F.transform(cells, lambda c: c["x"]), ";").alias("x"))
    rows = F.array_sort(F.collect_list(F.struct("site", "x")))
    return sites.groupBy("sample").agg(F.concat_ws("\t", F.col("sample").cast("string"), F.array_join(F.transform(rows, lambda r: r["x"]), "\t")).alias("value"))


def size_factor_lines(factors: DataFrame) -> DataFrame:
    return factors.orderBy("cell").select(F.concat_ws("\t", F.col("cell").cast("string"), F.col("size_factor").cast("string")).alias("value"))


# The comment lines of an estimates file.
ESTIMATES_HEAD = (
    "#Estimates for MCMC samples and allelic sequencing information.",
    "#Format: variables(id, for mcmc)/sites(for allelic sequencing information)\testimate type(mean, median, mode, or all)\testimates('allelic sequencing coverage,raw variance' for allelic sequencing information, which is also semicolon separated for site-wise categories)",
    "#",
)
ESTIMATES_MCMC = ("#", "#MCMC samples", "id\testimate type\tvalue")
ESTIMATES_ALLELIC = ("#", "#Allelic sequencing information", "sites\testimate type\tallelic sequencing coverage\traw variance")
ESTIMATES_MAP = ("#", "#Map (chromosome number,locus number,reference nucleotide,alternative nucleotide)")


def estimate_lines(estimates: DataFrame, coverage: DataFrame | None = None, headers: DataFrame | None = None, kind: str = "all", kernel: str = "null") -> DataFrame:
    """(value): an estimates file in order, from (var, kind, value) and, if given, from (pseudo, kind, category, cov, var)
    and the map lines of ``site_headers``.
    """
    spark = estimates.sparkSession

    def fixed(part: int, texts: tuple[str, ...]) -> DataFrame:
        return spark.createDataFrame([(part, f"{i:02d}", t) for i, t in enumerate(texts)], "part int, key string, value string")

    def rows(part: int, df: DataFrame, key, value) -> DataFrame:
        return df.select(F.lit(part).alias("part"), key.alias("key"), value.alias("value"))

    named = F.concat_ws("\t", "var", "kind")
    out = fixed(0, (*ESTIMATES_HEAD, f"#Type of estimates->{kind}", f"#Distribution of KDE->{kernel}", *ESTIMATES_MCMC))
    out = out.unionByName(rows(1, estimates, named, F.concat_ws("\t", named, F.col("value").cast("string"))))
    if coverage is not None:
        pairs = F.array_sort(F.collect_list(F.struct("category", F.concat_ws(",", F.col("cov").cast("string"), F.col("var").cast("string")).alias("x"))))
        each = coverage.groupBy("pseudo", "kind").agg(F.array_join(F.transform(pairs, lambda p: p["x"]), ";").alias("x"))
        site = F.concat_ws("\t", "pseudo", "kind")
        out = out.unionByName(fixed(2, ESTIMATES_ALLELIC)).unionByName(rows(3, each, site, F.concat_ws("\t", site, "x"))).unionByName(fixed(4, ESTIMATES_MAP))
        out = out.unionByName(rows(5, headers, F.col("pseudo"), F.col("value")))
    return out.orderBy("part", "key").select("value")
