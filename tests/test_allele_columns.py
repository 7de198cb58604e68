"""Allele counts of rows with a column for each nucleotide, against those of long rows."""

from pyspark.sql import functions as F

from phyloquarry.operators import calls
from phyloquarry.plans import catalog
from phyloquarry.plans.views import view

COLUMNS = {"A": "r1", "C": "r2", "G": "r3"}


def test_columns_have_the_counts_of_long_rows(spark):
    rows = [(1, 0, 3, 0, None), (1, 1, 2, 0, 4), (1, 1, 2, 5, 4), (2, 0, 0, 0, 0), (2, 3, 0, -1, 7), (None, 4, 1, 0, 0), (3, None, 6, 0, 0)]  # a repeated cell counts once
    wide = spark.createDataFrame(rows, "site long, cell long, r1 long, r2 long, r3 long")
    long = wide.select("site", "cell", F.inline(F.array(*[F.struct(F.lit(n).alias("nuc"), F.col(c).alias("reads")) for n, c in COLUMNS.items()])))
    key = lambda r: tuple(str(x) for x in r)
    found, want = calls.allele_columns(wide, COLUMNS), calls.allele_counts(long)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert found.dtypes == want.dtypes


def test_rows_are_not_multiplied_by_nucleotides(spark):
    plan = catalog.a50_allele_counts(view(spark, "/root/testdata/sf0.001", "reads"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    kinds = [line.strip(" :+-").split(" ")[0] for line in plan]
    assert kinds.index("Generate") < kinds.index("Aggregate") < kinds.index("Join")  # sites are expanded after their sums
