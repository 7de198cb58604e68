import pytest

from phyloquarry.plans import model_catalog
from phyloquarry.sinks import text as sinks
from phyloquarry.sources import newick, text


def put(tmp_path, name, body):
    path = tmp_path / name
    path.write_text(body)
    return str(path)


FULL = """=numSamples=
2
=numCandidateMutatedSites=
2
=numBackgroundSites=
3
=mutations=
chr1\t10\tA\tC\tC,G,T;3,0,0,10\tC,G,T;0,0,0,0
chrX\t20\tG\tT,A\tT,A,C;1,2,3,9\tT,A,C;0,0,0,4
=background=
0,4\t1,2
5,6
"""


def test_read_counts(spark, tmp_path):
    parts = text.sections(spark, put(tmp_path, "full.tsv", FULL))
    assert text.number(parts["numSamples"]) == 2
    sites = text.site_rows(parts["mutations"])
    rows = {(r.pos, r.cell): r for r in text.cell_reads(sites).collect()}
    assert rows[10, 0].reads == [3, 0, 0] and rows[10, 0].ref_reads == 7
    assert rows[20, 0].ref_reads == 3 and rows[20, 1].cov == 4 and rows[20, 0].alts == ["T", "A"]
    background = {(r.name, r.n_reads): r.occurrences for r in text.background_rows(parts["background"], ["alt1", "cov"]).collect()}
    assert background == {("alt1", 0): 4, ("alt1", 1): 2, ("cov", 5): 6}


def test_supports(spark, tmp_path):
    body = "=mutations=\nchr1\t10\tA\tC\t10\t3\t0\t0\n"
    parts = text.sections(spark, put(tmp_path, "sup.tsv", body))
    rows = {r.cell: r for r in text.cell_reads(text.site_rows(parts["mutations"], True), True).collect()}
    assert rows[0].cov == 10 and rows[0].reads == [3] and rows[0].ref_reads == 7 and rows[1].cov == 0


def test_cell_names(spark, tmp_path):
    assert sorted(r.cell for r in text.cell_names(spark, put(tmp_path, "n", "a b\n c\n\n")).collect()) == ["a", "b", "c"]
    path = put(tmp_path, "t", "dir/x1.bam\tCT\ndir/x2.bam\tCN\n")
    assert [r.cell for r in text.tumour_cell_names(spark, path).collect()] == ["x1"]
    with pytest.raises(Exception, match="Not two columns"):
        text.tumour_cell_names(spark, put(tmp_path, "b", "a\tb\tc\n")).collect()


def test_trace_and_maps(spark, tmp_path):
    path = put(tmp_path, "t.log", "# x\nSample\ta\tb\n0\t1.5\t2\n10\t3\t4\n")
    assert {(r.sample, r["var"]): r.value for r in text.trace_log(spark, path).collect()} == {(0, "a"): 1.5, (0, "b"): 2, (10, "a"): 3, (10, "b"): 4}
    with pytest.raises(Exception, match="Ragged"):
        text.trace_log(spark, put(tmp_path, "r.log", "Sample\ta\tb\n0\t1\n")).collect()
    log = put(tmp_path, "c.log", "Sample\tsite1\tsite2\n0\t1,2;3,4\t5,6;7,8\n#site1->chr1,10,A,C\n")
    got = {(r.place, r.category): (r.cov, r["var"]) for r in text.coverage_samples(spark, log).collect()}
    assert got == {(0, 0): (1, 2), (0, 1): (3, 4), (1, 0): (5, 6), (1, 1): (7, 8)}
    assert text.site_map(spark, log).first().pos == 10
    assert text.state_samples(spark, log).where("place = 1 and cell = 1").first().ado == 8


def test_genes(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'Chr\tStart\tEnd\tgene.REFGENE\nchr1\t1\t5\t"G;H"\n')
    assert text.annotated_genes(spark, path).first().gene == "G;H"
    assert text.gene_map(spark, put(tmp_path, "m", "# c\nchr1 1 5 G\n")).first().end_pos == 5
    assert [r.gene for r in text.gene_names(spark, put(tmp_path, "w", "gene\nA\nA\n")).collect()] == ["A"]
    assert text.variant_sites(spark, put(tmp_path, "v", "chr1 7 A C,G\n")).first().alts == ["C", "G"]
    loci = spark.createDataFrame([("chr1,5,A,C,G;chr2,6,C,T",)], "x string").select(text.loci("x").alias("l")).first().l
    assert [(x.chrom, x.alts) for x in loci] == [("chr1", ["C", "G"]), ("chr2", ["T"])]


def test_newick(spark, tmp_path):
    path = put(tmp_path, "t.nwk", "((a:1,b:2):1,(c[&rate=2.5]:1,d:1)x:2):0.5;\n((a:1,b:1):1,c:2);\n")
    nodes = newick.read_trees(spark, path)
    rows = nodes.where("label = 'c'").orderBy("tree").collect()
    assert rows[0].meta == {"rate": "2.5"} and [r.length for r in rows] == [1, 2]
    assert newick.branch_rates(nodes).where("label = 'c'").orderBy("tree").first().rate == 2.5
    texts = [r.newick for r in newick.to_newick(nodes).orderBy("tree").collect()]
    assert texts[0] == "((a:1,b:2):1,(c[&rate=2.5]:1,d:1)x:2):0.5;"
    assert newick.read_trees(spark, path, 0.5).select("tree").distinct().count() == 1
    body = "#NEXUS\nBegin trees;\ntranslate 1 a, 2 'b';\ntree T1 = [&R] (1:1,2:1);\nEnd;\n"
    assert {r.label for r in newick.read_trees(spark, put(tmp_path, "t.nex", body)).collect()} == {None, "a", "b"}
    assert newick.nexus(newick.to_newick(nodes)).count() == 5


def test_writers(spark, tmp_path):
    records = spark.createDataFrame([("chr2", 5, "r2"), ("chr1", 9, "r1")], "chrom string, pos long, record string")
    head = sinks.vcf_header(["x"], ["0/0", "0/1"], "20260101", "caller")
    lines = sinks.vcf_lines(records, head, ["chr1", "chr2"])
    sinks.write_lines(lines, str(tmp_path / "out"))
    got = [r.value for r in lines.collect()]
    assert got[0] == "##fileformat=VCFv4.3" and got[-2:] == ["r1", "r2"] and got[-3].endswith("\tx")
    sites = spark.createDataFrame([(7, "chr1", 10, "A", "C")], "site long, chrom string, pos long, ref string, alt string")
    assert sinks.site_headers(sites, 4).first().value == "#site0007->chr1,10,A,C"
    samples = spark.createDataFrame([(1, 0, 0, 1, 0), (1, 0, 1, 2, 1), (1, 1, 0, 0, 0)], "sample long, site int, cell int, genotype int, ado int")
    assert sinks.sampled_line(samples).first().value == "1\t1,0;2,1\t0,0"
    meta = spark.createDataFrame([({"b": "2", "a": "1"},)], "m map<string,string>")
    assert meta.select(sinks.metadata_text("m").alias("x")).first().x == "a=1,b=2"


def test_stream(spark, tmp_path):
    from phyloquarry.streaming import traces

    spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0)], traces.SCHEMA).write.parquet(str(tmp_path / "in"))
    q = traces.running_estimates(traces.tail(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("est").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("est").first().mean == 2.0


ESTIMATES = ["#MCMC samples", "id\testimate type\tvalue", "a\tmean\t1.5", "a\tmedian\t2.0", "#", "#Allelic sequencing information", "sites\testimate type\tx\ty"]
COVERAGES = ["site1\tmean\t3.0,4.0;5.0,6.0", "site1\tmedian\t1.0,2.0;3.0,4.0"]


def estimates_from(spark, tmp_path, *more):
    path = tmp_path / "estimates.txt"
    path.write_text("\n".join([*ESTIMATES, *more]) + "\n")
    return text.cached_estimates(spark, str(path))


def test_cached_estimates(spark, tmp_path):
    found = estimates_from(spark, tmp_path, *COVERAGES, "#", "#site1->chr1,7,A,C")
    assert sorted(map(tuple, found["estimates"].collect())) == [("a", "mean", 1.5), ("a", "median", 2.0)]
    assert sorted(map(tuple, found["coverage"].where("kind = 'mean'").collect())) == [("site1", "mean", 0, 3.0, 4.0), ("site1", "mean", 1, 5.0, 6.0)]
    assert [r.pseudo for r in found["sites"].collect()] == ["site1"]


@pytest.mark.parametrize(
    ("more", "said"),
    [
        (COVERAGES, "No map line for site1"),
        ([*COVERAGES, "#site1->chr1,7,A,C", "#site2->chr1,9,A,C"], "No estimates for site2"),
        ([COVERAGES[0], "#site1->chr1,7,A,C"], "kinds of estimates"),
        ([COVERAGES[0], "site1\tmedian\t1.0,2.0", "#site1->chr1,7,A,C"], "categories"),
    ],
)
def test_incomplete_estimates_are_errors(spark, tmp_path, more, said):
    with pytest.raises(ValueError, match=said):
        estimates_from(spark, tmp_path, *more)


def test_heights_of_a_wide_tree_take_linear_time():
    from time import process_time

    text = "(" + ",".join(f"s{i}:{1 + i % 3}" for i in range(20000)) + ");"
    start = process_time()
    nodes = newick.parse(text)
    assert process_time() - start < 2  # a maximum over all nodes for each node takes 16 seconds
    assert nodes[0]["height"] == 3 and nodes[3]["height"] == 0 and nodes[1]["height"] == 2


def test_site_headers_keep_numbers_longer_than_the_name(spark):
    sites = spark.createDataFrame([(1234567, "chr1", 10, "A", "C")], "site long, chrom string, pos long, ref string, alt string")
    assert model_catalog.k17_site_headers(sites).first().site == 1234567
