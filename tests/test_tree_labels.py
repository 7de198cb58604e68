import pytest
from pyspark.sql import functions as F

from phyloquarry.operators import genes, reads, trees
from phyloquarry.sources import newick, text


def test_gene_notes_come_back_from_the_tree_text(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("((a:1,b:1)x[&genotypes={0/0}]:1,c:2)r:0;\n")
    nodes = newick.read_trees(spark, str(tmp_path / "t.nwk"))
    rows = [(1, "a", "SM", "G1", "chr1", 9, "A", "C", "ISA"), (2, "a", "SM", "G2", "chr1", 5, "A", "G", "FSA"), (2, "x", "SM", "G2", "chr1", 5, "A", "G", "FSA")]
    classed = spark.createDataFrame(rows, "site long, node string, event string, gene string, chrom string, pos long, ref string, alt string, model string")
    labels = nodes.select("node", "label")
    notes = genes.gene_notes(classed).withColumnRenamed("node", "label").join(labels, "label").select("node", "key", "value")
    noted = newick.with_notes(nodes, notes)
    (tmp_path / "u.nwk").write_text(newick.to_newick(noted).first().newick + "\n")
    meta = {r.label: r.meta for r in newick.read_trees(spark, str(tmp_path / "u.nwk")).collect()}
    assert meta["a"]["pos"] == "{5,9}" and meta["a"]["gene_isa"] == "{G1}" and meta["a"]["alt_nuc_fsa"] == "{G}"
    assert meta["x"] == {"genotypes": "{0/0}"} | {k + e: v for e in ("", "_fsa") for k, v in {"chr": "{chr1}", "pos": "{5}", "ref_nuc": "{A}", "alt_nuc": "{G}", "event_type": "{SM}", "gene": "{G2}"}.items()}
    assert not meta["c"]


def test_genotype_notes_replace_older_ones(spark):
    nodes = spark.createDataFrame([(0, 0, {"genotypes": "{1/1}", "rate": "2"}), (0, 1, None)], "tree long, node int, meta map<string,string>")
    notes = genes.genotype_notes(spark.createDataFrame([(2, 0, "0/1"), (1, 0, "0/0")], "site long, node int, genotype string"))
    assert {r.node: r.meta for r in newick.with_notes(nodes, notes).collect()} == {0: {"genotypes": "{0/0,0/1}", "rate": "2"}, 1: {}}


def test_negative_branches_unknown_names_and_repeated_counts_are_errors(spark):
    nodes = spark.createDataFrame([(0, "r", None, 2.0), (0, "a", "r", 1.5), (0, "b", "r", 0.0)], "tree long, node string, parent string, height double")
    assert {r.node: r.height for r in trees.scaled_heights(nodes, 0.9).collect()} == {"r": 1.8, "a": 1.5, "b": 0.0}
    for wrong in (
        trees.scaled_heights(nodes, 0.5),
        reads.known_names(nodes.select(F.col("node").alias("cell")), spark.createDataFrame([("z",)], "cell string")),
        *(text.embedded_background(spark.createDataFrame([(x,)], "background string")) for x in ("1,2;1,3", "-1,2", "1,-2", "1")),
    ):
        with pytest.raises(Exception, match="negative branch|Not a cell|Negative, repeated"):
            wrong.collect()


def test_calling_rates(spark):
    nodes = spark.createDataFrame([("a", 3.0)], "node string, rate double")
    rate = lambda *a: trees.calling_rates(nodes, 2.0, *a).first().branch_rate
    assert (rate(False), rate(True), rate(False, False), rate(True, False)) == (6.0, 2.0, 3.0, 1.0)


def test_caterpillar_of_one_and_three_tips(spark):
    tips = lambda n: spark.createDataFrame([(i, f"c{i}") for i in range(n)], "place long, label string")
    rows = lambda n: sorted((r.node, r.parent, r.height) for r in trees.caterpillar(tips(n), 1.0, 0.5).collect())
    assert rows(1) == [(0, 1, 0.0), (1, None, 1.5)]
    assert rows(3) == [(0, 3, 0.0), (1, 3, 0.0), (2, 4, 0.0), (3, 4, 1.5), (4, 5, 2.0), (5, None, 2.5)]
