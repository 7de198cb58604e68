"""One key or one value with a third of all rows: same results, spread over tasks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phyloquarry.functions import special
from phyloquarry.operators import ranks, reads, summaries


def largest_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(9)
    data = [(draw.choice(["hot", "hot", "a", "b", None]), draw.choice([5.0, 5.0, draw.gauss(0, 3)]), i) for i in range(3000)]
    return data, spark.createDataFrame(data, "k string, value double, sample long").repartition(6)


def test_log_sum_exp_over_any_range(spark):
    data = {"a": [0.0] * 1000, "b": [-1e6, -1e6 - 1, -3e6], "c": [1e5, -1e5], "d": [float("-inf")], "e": [float("-inf"), 2.0], "f": [709.9, 709.9], "g": [float("nan"), 1.0], "h": [-0.5, 499.9, 500.1]}
    table = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, value double")
    found = {r.k: r.lse for r in special.grouped_log_sum_exp(table, ["k"], "value").collect()}
    for k, vs in data.items():
        want = np.logaddexp.reduce(vs)
        assert (math.isnan(want) and math.isnan(found[k])) or found[k] == pytest.approx(want, rel=1e-14), k


def test_ties_of_a_hot_key(rows):
    data, table = rows
    for largest in (True, False):
        found = summaries.best_with_ties(table, ["k"], "value", largest)
        best = {}
        for k, v, _ in data:
            best[k] = v if k not in best else (max if largest else min)(best[k], v)
        assert sorted((str(r.k), r.sample) for r in found.collect()) == sorted((str(k), i) for k, v, i in data if v == best[k])
    nulls = table.withColumn("value", F.lit(None).cast("double"))
    assert summaries.best_with_ties(nulls, ["k"], "value").count() == len(data)


def test_medians_of_a_shared_value(rows):
    data, table = rows
    found = {r.k: (r.n, r.mean, r.median) for r in ranks.medians(table, ["k"], "value").collect()}
    for k in {k for k, _, _ in data}:
        own = [v for j, v, _ in data if j == k]
        assert found[k][0] == len(own) and found[k][1:] == (pytest.approx(np.mean(own)), pytest.approx(np.median(own)))


def test_running_sums(spark, rows):
    data, table = rows
    found = ranks.running(table.withColumn("one", F.lit(1)), ["k"], ["sample"], ["one", "value"])
    for r in found.where("sample % 97 = 0").collect():
        own = [v for k, v, i in data if k == r.k and i < r.sample]
        assert r._before_one == len(own) and r._before_value == pytest.approx(sum(own)) and r._all_one == sum(k == r.k for k, _, _ in data)
    met = ranks.with_key_values(table, table.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"])
    assert met.count() == len(data) and met.where("n is null").count() == 0


def test_missing_threshold_where_most_sites_are_alike(spark):
    draw = random.Random(4)
    cells = [(s, c, 0 if (s % 3 == 0 and c < 2) or draw.random() < 0.05 else 7) for s in range(300) for c in range(8)]
    table = spark.createDataFrame(cells, "site long, cell long, cov long")
    missing = {}
    for s, _, v in cells:
        missing[s] = missing.get(s, 0) + (v == 0)
    for most in (0.02, 0.08, 0.5, 0.0):
        order = sorted(missing, key=lambda s: (-missing[s], s))
        left, gone = sum(missing.values()), 0
        while gone < len(order) and left > most * 8 * (len(order) - gone):
            left -= missing[order[gone]]
            gone += 1
        assert {r.site for r in reads.below_missing(table, most).collect()} == set(order[gone:])


def test_site_numbers_of_one_chromosome(spark):
    draw = random.Random(2)
    sites = [(i, draw.choice(["chr1", "chr1", "chr2", "chrX"]), draw.randrange(500), draw.choice("ACGT")) for i in range(900)]
    found = {r.site: r.site_rank for r in reads.numbered_sites(spark.createDataFrame(sites, "site long, chrom string, pos long, alt string").repartition(5)).collect()}
    order = sorted(sites, key=lambda s: (["chr1", "chr2", "chrX"].index(s[1]), s[2], s[3]))
    key = {s[0]: s[1:] for s in sites}
    assert sorted(found.values()) == list(range(1, 901))
    assert [key[i] for i in sorted(found, key=found.get)] == [s[1:] for s in order]
