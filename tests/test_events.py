"""Events by difference, allele adaptation and the order of count vectors on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from phyloquarry.operators import calls, genes, reads
from phyloquarry.plans.model_catalog import DIFFERENCES


@pytest.mark.parametrize(("pair", "events"), [*DIFFERENCES.items(), (("0/0", "0/0"), ""), (("0/1", "1/0"), ""), (("01/1", "1/01"), "D,I,SB"), (("1/1", "0/-"), "D,SB"), (("1/01", "01/1"), "D,I,SB")])
def test_pairs(pair, events):
    assert genes.pair_events(*pair) == events


def test_a_lost_allele_does_not_come_back():
    with pytest.raises(ValueError, match="0/- -> 0/1"):
        genes.pair_events("0/-", "0/1")


def test_events_of_occurring_pairs(spark):
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r")], "node string, parent string")
    gt = spark.createDataFrame([(1, "r", "0/0"), (1, "a", "0/1"), (1, "b", "0/0"), (2, "r", "0/1"), (2, "a", "0/01"), (2, "b", "1/-"), (3, "a", "0/1")], "site long, node string, genotype string")
    found = genes.difference_events(genes.branch_pairs(nodes, gt)).select("site", "node", "events").collect()
    assert sorted(map(tuple, found)) == [(1, "a", "SM"), (2, "a", "I,SB"), (2, "b", "D")]
    assert genes.difference_events(genes.branch_pairs(nodes, gt.where("false"))).count() == 0


def folded(rows):
    """Site by site, cell by cell, allele by allele, with the list of alternatives so far."""
    genotypes, known, counts = [], {}, {}
    for site, cell, alts, alphabet, nucs in sorted(rows, key=lambda r: r[:2]):
        own = known.setdefault(site, list(dict.fromkeys(x.upper() for x in alts)))
        out = []
        for letter in alphabet.split("/"):
            at = {"1": 0, "2": 1}.get(letter)
            nuc = (nucs[at] if nucs and at < len(nucs) else "N").upper() if at is not None else None
            if nuc is None or nuc == "N":
                out.append("0" if nuc is None else "1")
                continue
            if nuc not in own:
                own.append(nuc)
            counts.setdefault((site, nuc), []).append(cell)
            out.append(str(own.index(nuc) + 1))
        genotypes.append((site, cell, "/".join(out)))
    return genotypes, [(s, n, i + 1, len(counts.get((s, n), [])), len(set(counts.get((s, n), [])))) for s, own in known.items() for i, n in enumerate(own)]


def test_adapted_genotypes(spark):
    draw = random.Random(1)
    alts = {s: draw.choice([["A"], ["C", "G"], [], ["t"]]) for s in range(30)}
    rows = [(s, c, alts[s], draw.choice(["0/0", "0/1", "1/1", "1/2"]), draw.choice([None, [], ["A"], ["T", "G"], ["c", "A"], ["N"]])) for s in range(30) for c in range(9)]
    genotypes, alternatives = calls.adapted_genotypes(spark.createDataFrame(rows, "site long, cell long, alts array<string>, alphabet string, nucs array<string>"))
    want = folded(rows)
    assert sorted(map(tuple, genotypes.collect())) == sorted(want[0])
    assert sorted(tuple(r) for r in alternatives.collect()) == sorted(want[1])
    with pytest.raises(Exception, match="Not an allele"):
        calls.adapted_genotypes(spark.createDataFrame([(1, 1, ["A"], "0/3", ["A"])], "site long, cell long, alts array<string>, alphabet string, nucs array<string>"))[0].collect()


def test_vectors_are_ordered_by_number(spark):
    rows = [(0, [10, 2]), (1, [9, 100]), (2, [-1, 5]), (3, [9, 11]), (4, [10, 2]), (5, [2**40, 0]), (6, [-(2**40), 0])]
    table = spark.createDataFrame(rows, "site long, counts array<long>")
    found = {r.site: r.pattern_id for r in reads.vector_ids(table).collect()}
    order = sorted({tuple(v) for _, v in rows})
    assert found == {s: order.index(tuple(v)) + 1 for s, v in rows}
    ragged = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 7)], "site long, cell long, cov long")
    with pytest.raises(ValueError):
        reads.count_vectors(ragged, ["cov"])
    assert reads.count_vectors(ragged.where("site = 1"), ["cov"]).select(F.array_join(F.col("counts").cast("array<string>"), ",").alias("x")).first().x == "5,6"
