"""Estimates of keys with few rows, against those of keys of any size; the estimates of a file are checked in one pass."""

import pytest

from phyloquarry.operators import summaries
from phyloquarry.plans import file_catalog
from phyloquarry.plans.views import view


def test_short_keys_have_the_estimates_of_long_ones(spark):
    values = {"a": [3.0, 1.0, 2.0], "b": [4.0, 1.0, 1.0, 9.0], "c": [float("inf"), 5.0, float("nan")], "d": [float("nan")], None: [7.0, 8.0]}
    rows = spark.createDataFrame([(k, x, i) for k, xs in values.items() for i, x in enumerate(xs)], "key string, x double, i long")
    found = {r.key: r for r in summaries.short_estimates(rows, ["key"], ["x", "i"]).collect()}
    want = {r.key: r for r in summaries.estimates(rows, ["key"], "x").collect()}
    assert set(found) == set(values) and set(want) == set(values) - {"d"}
    assert all((found[k].mean_x, found[k].median_x) == pytest.approx((w["mean"], w["median"])) for k, w in want.items())
    assert found["d"].mean_x is None and found["d"].median_x is None and found["b"].median_i == 1.5


def test_site_estimates_are_read_without_many_jobs(spark):
    """Placing values of short keys by ranges, and jobs for each check of the file, made it 56 jobs; 33 are left."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("s13", "s13")
    try:
        file_catalog.s13_cached_estimates(*(view(spark, "/root/testdata/sf0.001", n) for n in ("trace", "reads", "sites")))
        n = len(tracker.getJobIdsForGroup("s13"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < n < 45
