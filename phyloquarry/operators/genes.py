"""Mapping mutations to genes and branches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the bins that turn the interval join into an equi-join; a site has one bin, a gene those it spans.
BIN = 100_000

#: Event codes from parent to child genotype; no event on the diagonal.
EVENTS = [
    ("0/0", "0/1", "SM"), ("0/0", "1/1", "HoCDM"), ("0/0", "1/2", "HeCDM"),
    ("0/1", "0/0", "SB"), ("0/1", "1/1", "HoSMA"), ("0/1", "1/2", "HeSMA"),
    ("1/1", "0/0", "DB"), ("1/1", "0/1", "SB"), ("1/1", "1/2", "HeSSM"),
    ("1/2", "0/0", "DB"), ("1/2", "0/1", "SB"), ("1/2", "1/1", "HoSSM"),
]


def first_genes(sites: DataFrame, genes: DataFrame) -> DataFrame:
    """``sites`` (site, chrom, pos) with the first gene that holds the position: least start, end, upper-case name.

    Both sides meet in bins of BIN bases, so the join is an equi-join whatever the gene density.
    """
    binned = genes.withColumn("bin", F.explode(F.sequence(F.expr(f"start_pos div {BIN}"), F.expr(f"end_pos div {BIN}"))))
    met = sites.withColumn("bin", F.expr(f"pos div {BIN}")).join(binned, ["chrom", "bin"]).where("pos BETWEEN start_pos AND end_pos")
    first = F.min(F.struct("start_pos", "end_pos", F.upper("gene").alias("u"), "gene")).alias("g")
    return met.groupBy(*sites.columns).agg(first).select(*sites.columns, F.col("g.gene").alias("gene"))


def listed_genes(genes: DataFrame, names: DataFrame) -> DataFrame:
    """Only genes in a list of names."""
    return genes.join(names.select("gene").distinct(), "gene", "left_semi")


def branch_events(nodes: DataFrame, genotypes: DataFrame, events: DataFrame) -> DataFrame:
    """(site, node, parent, event) where the genotype changes between a node and its parent."""
    child = genotypes.select("site", "node", F.col("genotype").alias("child_gt"))
    parent = genotypes.select("site", F.col("node").alias("parent"), F.col("genotype").alias("parent_gt"))
    edges = nodes.where("parent IS NOT NULL").select("node", "parent")
    both = child.join(edges, "node").join(parent, ["site", "parent"])
    return both.join(F.broadcast(events), ["parent_gt", "child_gt"]).select("site", "node", "parent", "event")  # 12 events


def pair_events(parent: str, child: str) -> str:
    """The events that turn a genotype into another, as sorted codes joined by commas; empty if there are none.

    Alleles are 0 and 1, anything else counts as a missing one; chromosomes are parted by / and hold one allele or, with
    insertions, more. Without insertions all alleles are compared at once, with them chromosome by chromosome: crosswise
    where only the first allele of the one with insertions is like the second chromosome of the other. Alleles that both have cancel;
    what is left is paired in order: 0 to 1 is a mutation (SM), 1 to 0 a back mutation (SB), an allele without partner is
    lost (D) or gained (I). A chromosome that grows to unlike alleles has also mutated from the one it begins with. A missing allele
    that comes back is an error.
    """
    if parent == child:
        return ""
    old, new = parent.split("/"), child.split("/")
    grown, grows = len(parent) > 3, len(child) > 3
    if grown != grows:
        more, less = (old, new) if grown else (new, old)
        if more[0][0] != less[0][0] and more[0][0] == less[1][0]:
            new = new[::-1]
    elif not grown:
        old, new = ["".join(old)], ["".join(new)]
    codes = []
    for a, b in zip(old, new, strict=True):
        gone, come = [], list(b)
        for x in a:
            if x in come:
                come.remove(x)
            elif not x.isdigit():
                raise ValueError(f"Not a possible transition: {parent} -> {child}")
            else:
                gone.append(x)
        if len(a) < len(b) and b[0] != b[1]:
            first = ("0", "1") if a[0] == b[0] else ("1", "0")
            gone, come = [first[0], *gone], [first[1], *come]
        for i in range(max(len(gone), len(come))):
            x, y = (v[i] if i < len(v) and v[i] in "01" else "?" for v in (gone, come))
            if x != y:
                codes.append({"01": "SM", "10": "SB"}.get(x + y) or ("D" if y == "?" else "I"))
    return ",".join(sorted(codes))


def branch_pairs(nodes: DataFrame, genotypes: DataFrame) -> DataFrame:
    """(site, node, parent, parent_gt, child_gt) of each branch at whose ends the genotypes differ."""
    child = genotypes.select("site", "node", F.col("genotype").alias("child_gt"))
    edges = nodes.where("parent IS NOT NULL").select("node", "parent")
    inner = edges.select(F.col("parent").alias("node")).distinct()  # tips are nobody's parents and needn't meet children
    parent = genotypes.join(inner, "node", "left_semi").select("site", F.col("node").alias("parent"), F.col("genotype").alias("parent_gt"))
    return child.join(edges, "node").join(parent, ["site", "parent"]).where("parent_gt <> child_gt").select("site", "node", "parent", "parent_gt", "child_gt")


def difference_events(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``events``, by ``pair_events`` of each distinct pair of genotypes that occurs in a batch.

    The pairs themselves are made once: no table of those that occur is needed.
    """

    @F.arrow_udf("string")
    def told(parents: pa.Array, children: pa.Array) -> pa.Array:
        a, b = parents.dictionary_encode(), children.dictionary_encode()
        both, place = np.unique(a.indices.to_numpy() * np.int64(max(len(b.dictionary), 1)) + b.indices.to_numpy(), return_inverse=True)
        found = [pair_events(a.dictionary[i].as_py(), b.dictionary[j].as_py()) for i, j in (divmod(int(x), len(b.dictionary)) for x in both)]
        return pa.array(found, pa.string()).take(pa.array(place))

    met = pairs.where("parent_gt IS NOT NULL AND child_gt IS NOT NULL")
    return met.withColumn("events", told("parent_gt", "child_gt"))


def event_table(spark) -> DataFrame:
    return spark.createDataFrame(EVENTS, "parent_gt string, child_gt string, event string")


def listed_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, listed): the events of each key by code, as ``code:number`` joined by commas."""
    each = events.groupBy(*keys, "event").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("event", "n")))  # a row for each code
    return each.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["event"], x["n"].cast("string"))), ",").alias("listed"))


def violates_infinite_sites(events: Column) -> Column:
    """More than one event, or one that is no single mutation."""
    return (F.size(events) > 1) | (F.element_at(events, 1) != "SM")


def site_classes(branch_genes: DataFrame) -> DataFrame:
    """Each (site, gene, node, event) with ``model``: FSA if it occurs on several branches or violates, else ISA."""
    per = Window.partitionBy("site", "gene")
    return branch_genes.withColumn("model", F.when((F.count(F.lit(1)).over(per) > 1) | (F.col("event") != "SM"), "FSA").otherwise("ISA"))


def genes_by_branch(branch_genes: DataFrame) -> DataFrame:
    """(node, genes): distinct gene names in order, joined by commas."""
    return branch_genes.groupBy("node").agg(F.array_join(F.sort_array(F.collect_set("gene")), ",").alias("genes"))


def clean_gene(col: Column) -> Column:
    """Quotes dropped; a semicolon becomes a slash."""
    return F.regexp_replace(F.regexp_replace(col, "[\"']", ""), ";", "/")


#: Names of what a branch tells of its mutations, and the columns they are taken from.
NOTES = {"chr": "chrom", "pos": "pos", "ref_nuc": "ref", "alt_nuc": "alt", "event_type": "event", "gene": "gene"}


def gene_notes(classed: DataFrame) -> DataFrame:
    """(node, key, value): the mutations of each branch, for its tree label, over all sites and by model.

    ``classed`` are ``site_classes`` with the sites' columns. Keys without ending list all mutations, those ending in
    _isa or _fsa the ones of that model; values are {a,b,...} in the order of chromosome, position, number of events,
    events and gene. A label is one text, so a branch's mutations meet in one row.
    """
    rows = classed.withColumn("ending", F.explode(F.array(F.lit(""), F.concat(F.lit("_"), F.lower("model")))))
    order = ["chrom", "pos", F.size(F.split("event", ",")).alias("n_events"), "event", "gene", "ref", "alt"]
    listed = rows.groupBy("node", "ending").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("m"))
    notes = [F.struct(F.concat(F.lit(k), F.col("ending")).alias("key"), braced(F.col("m")[c].cast("array<string>")).alias("value")) for k, c in NOTES.items()]
    return listed.select("node", F.explode(F.array(*notes)).alias("n")).select("node", "n.key", "n.value")


def genotype_notes(genotypes: DataFrame) -> DataFrame:
    """(node, key, value): the genotypes of each node in the order of sites, under the key ``genotypes``."""
    listed = genotypes.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("site", "genotype"))).alias("m"))
    return listed.select("node", F.lit("genotypes").alias("key"), braced(F.col("m")["genotype"]).alias("value"))


def braced(values: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(values, ","), F.lit("}"))
