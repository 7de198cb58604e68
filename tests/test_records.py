"""Trees over many lines and splits, and single trees."""

import random

import pytest

from phyloquarry.sources import newick, records, text

NEXUS = """#NEXUS
[a comment; with a mark]
Begin trees;
  Translate
    1 'a;b',
    2 c
  , 3 d;
tree TREE1 [first; of two] = [&R] ((1[&rate=2.0,note='x;y']:1,
    2:1):0.5,
  3:1.5):0;
TREE t2 = [&R] (1:1,(2:2,
3:2)[&x={1,
2}]:1):0;
End;
"""


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def nodes(df):
    return sorted(((r.tree, r.node, r.parent, r.label, r.length, tuple(sorted(r.meta.items()))) for r in df.collect()), key=str)


def test_wrapped_trees_read_like_one_line_trees(spark, tmp_path):
    wrapped = newick.read_trees(spark, put(tmp_path, "a.nex", NEXUS))
    one_line = NEXUS.replace("\n    2:1", "2:1").replace("\n  3:1.5", "3:1.5").replace("\n3:2", "3:2").replace("{1,\n2}", "{1,2}").replace("\n  , 3", ", 3").replace("'a;b',\n", "'a;b', ").replace("Translate\n", "Translate ").replace("(2:2,\n", "(2:2,")
    want = newick.read_trees(spark, put(tmp_path, "b.nex", one_line))
    assert [r[1:] for r in nodes(wrapped)] == [r[1:] for r in nodes(want)]
    assert {r.label for r in wrapped.collect()} == {None, "a;b", "c", "d"}
    assert next(r.meta for r in wrapped.collect() if r.label == "a;b" and r.meta) == {"rate": "2.0", "note": "'x;y'"}


@pytest.mark.parametrize("size", [64, 700, 10**8])
def test_splits_cut_no_record(spark, tmp_path, size):
    draw = random.Random(size)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    texts = []
    for i in range(60):
        note = draw.choice(["", "[x;y\n;]", "'q;''r;'", "\n\n", "[it's]", "'[;'"])
        texts.append(f"({i}:1,\n{note}b{'x' * draw.randrange(90)}:2)" + "\n" * draw.randrange(3))
    path = put(tmp_path, "many.txt", ";".join(texts) + ";\n")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        found = records.records(spark, path)
        assert [r.text for r in found.orderBy("record").collect()] == texts
        assert size > 10**6 or records.pieces(spark, path, ";").select("block").distinct().count() >= 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")


FILE = ["=numSamples=", "2", "=numCandidateMutatedSites=", "{sites}", "=numBackgroundSites=", "{background}", "=mutations=", *[f"chr1\t{{i}}\tA\tC\tA,C,G;1,{{i}},0,9\tA,C,G;0,0,0,{{i}}".format(i=i) for i in range(40)], "", "=background=", "0,30\t1,50", "2,79\t9,1"]


@pytest.mark.parametrize("size", [64, 300, 10**8])
def test_sections_over_splits_and_files(spark, tmp_path, size):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lines = [x.format(sites=40, background=40) if x.startswith("{") else x for x in FILE]
    path = put(tmp_path, "one.tsv", "\n".join(lines) + "\n")
    (tmp_path / "many").mkdir()
    for k in range(0, len(lines), 7):
        put(tmp_path / "many", f"part-{k:05d}", "\n".join(lines[k : k + 7]) + "\n")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        for where in (path, str(tmp_path / "many")):
            assert {k: v.count() for k, v in text.sections(spark, where).items()} == {"numSamples": 1, "numCandidateMutatedSites": 1, "numBackgroundSites": 1, "mutations": 40, "background": 2}
            reads, background = text.read_counts(spark, where, ["alt1", "coverage"])
            assert sorted((r.pos, r.cell, r.cov) for r in reads.collect()) == sorted([(i, 0, 9) for i in range(40)] + [(i, 1, i) for i in range(40)])
            assert sorted(tuple(r) for r in background.collect()) == [("alt1", 0, 30), ("alt1", 1, 50), ("coverage", 2, 79), ("coverage", 9, 1)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("change", "says"), [(("{sites}", "41"), "numCandidate"), (("{background}", "39"), "Background of"), (("2", "3"), "numSamples"), (("=background=", "=other="), "section"), (("=background=", "=mutations="), "section")])
def test_declared_numbers_are_checked(spark, tmp_path, change, says):
    lines = [change[1] if x == change[0] else x.format(sites=40, background=40) if x.startswith("{") else x for x in FILE]
    with pytest.raises(ValueError, match=says):
        text.read_counts(spark, put(tmp_path, "bad.tsv", "\n".join(lines)), ["alt1", "coverage"])


def test_read_states(spark, tmp_path):
    for cell, supports in (("A,C,G;1,2,3", False), ("A,C,G;1,2,3,4,5", False)):
        path = put(tmp_path, f"s{len(cell)}.tsv", f"=mutations=\nchr1\t5\tA\tC\t{cell}\n")
        with pytest.raises(Exception, match="read states"):
            text.read_counts(spark, path, [], supports)[0].collect()


def test_states():
    assert [records.after(t, s) for t, s in (("a'b", 0), ("a'b'", 0), ("it''s'", 1), ("[x'", 0), ("'] y", 2), ("", 2), ("'[", 0), ("]", 0))] == [1, 0, 0, 2, 0, 2, 1, 0]


def test_one_tree(spark, tmp_path):
    path = put(tmp_path, "one.nwk", "((1:1,\n 2:1):0.5,3:1.5)\n;\n")
    labels = lambda df: sorted(r.label for r in df.collect() if r.label)
    assert labels(newick.read_tree(spark, path)) == ["1", "2", "3"]
    assert labels(newick.read_tree(spark, path, ["a", "b", "c"])) == ["a", "b", "c"]
    assert labels(newick.read_tree(spark, path, ["z", "a", "b", "c"])) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="taxa"):
        newick.read_tree(spark, path, ["a"])
    for text, n in (("", 0), ("(a,b);(c,d);", 2)):
        with pytest.raises(ValueError, match=f"but {n} provided"):
            newick.read_tree(spark, put(tmp_path, f"bad{n}.nwk", text))
    assert newick.has_trunk(newick.read_tree(spark, put(tmp_path, "t.nwk", "((a:1,b:1):2):0"))).first().trunk
    assert not newick.has_trunk(newick.read_tree(spark, path)).first().trunk


def test_deep_trees(spark, tmp_path):
    n = 3000
    deep = "(" * n + "t:1" + "".join(f",x{i}:1):1" for i in range(n)) + ";"
    found = newick.read_tree(spark, put(tmp_path, "deep.nwk", deep))
    assert found.count() == 2 * n + 1
    again = newick.to_newick(found).first().newick
    assert newick.read_tree(spark, put(tmp_path, "again.nwk", again)).count() == 2 * n + 1
