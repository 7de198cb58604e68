"""Places, medians, burn-in and intervals of keys that spread over several parts, against plain Python."""

from collections import defaultdict
from statistics import median

import pytest

from phyloquarry.operators import summaries
from phyloquarry.operators.ranks import numbered


@pytest.fixture(scope="module")
def rows():
    many = [("hot", i, float((i * 7919) % 1009)) for i in range(2000)]
    return many + [(None, i, float(i * i % 7)) for i in range(9)] + [("one", 5, 2.5)]


@pytest.fixture(scope="module")
def trace(spark, rows):
    return spark.createDataFrame(rows, "var string, sample int, value double").repartition(3)


@pytest.fixture(scope="module", autouse=True)
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def by_key(rows):
    found = defaultdict(list)
    for k, s, v in rows:
        found[k].append((s, v))
    return found


def test_places_are_gapless_over_parts(spark, trace, rows):
    found = defaultdict(list)
    for r in numbered(trace, ["var"], ["value", "sample"]).collect():
        found[r.var].append((r._rank, (r.value, r.sample), r._all))
    for k, own in by_key(rows).items():
        want = sorted((v, s) for s, v in own)
        assert sorted(found[k]) == [(i + 1, x, len(own)) for i, x in enumerate(want)]
    assert numbered(trace.where("false"), ["var"], ["value"]).count() == 0


@pytest.mark.parametrize("up", [False, True])
def test_burn_in(trace, rows, up):
    found = summaries.after_burn_in(trace, 0.25, ["var"], up=up)
    assert found.columns == trace.columns
    left = by_key([tuple(r) for r in found.collect()])
    for k, own in by_key(rows).items():
        skip = -(-len(own) // 4) if up else len(own) // 4
        assert sorted(left[k]) == sorted(own)[skip:]


def test_medians_and_intervals(trace, rows):
    medians = {r["var"]: r["median"] for r in summaries.estimates(trace, ["var"]).collect()}
    intervals = {r["var"]: (r.hpd_low, r.hpd_high) for r in summaries.hpd(trace, ["var"]).collect()}
    for k, own in by_key(rows).items():
        values = sorted(v for _, v in own)
        width = max(int(0.95 * len(values) + 0.5), 1)
        runs = [(values[i + width - 1] - values[i], i) for i in range(len(values) - width + 1)]
        at = min(runs)[1]
        assert medians[k] == median(values)
        assert intervals[k] == (values[at], values[at + width - 1])
