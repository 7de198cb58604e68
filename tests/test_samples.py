"""Sample logs appended by a stream that fails, restarts and gets more files; taxa and backgrounds by name."""

import pytest
from pyspark.sql import functions as F

from phyloquarry.operators import reads
from phyloquarry.streaming import samples


def put(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def rows(spark, table):
    return sorted(tuple(r) for r in samples.samples(spark, table).collect())


def want(numbers):
    return sorted((n, p, c, (n + p + c) % 3, c % 2) for n in numbers for p in range(2) for c in range(3))


def line(n):
    return "\t".join([str(n), *(";".join(f"{(n + p + c) % 3},{c % 2}" for c in range(3)) for p in range(2))])


def test_no_row_is_lost_or_written_twice(spark, tmp_path):
    folder, table, checkpoint = tmp_path / "log", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    folder.mkdir()
    put(folder, "a", ["Sample\tsite0\tsite1", line(0), line(1)])
    put(folder, "b", [line(2), "# a comment", ""])
    samples.genotype_log(spark, str(folder), table, checkpoint, 1).awaitTermination()
    assert rows(spark, table) == want(range(3))
    put(folder, "c", [line(3)])
    put(folder, "d", [line(4), line(5)])
    calls = []

    def failing(batch):
        calls.append(1)
        found = samples.state_rows(batch)
        if len(calls) == 2:  # part of the second batch is there, then the driver's function fails
            found.limit(1).write.mode("overwrite").parquet(f"{table}/{samples.BATCH}=3")
            raise RuntimeError("lost")
        return found

    with pytest.raises(Exception, match="lost"):
        samples.appended(samples.log_lines(spark, str(folder), 1), table, checkpoint, failing).awaitTermination()
    for _ in range(2):
        samples.genotype_log(spark, str(folder), table, checkpoint, 1).awaitTermination()
        assert rows(spark, table) == want(range(6))


def test_coverage_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    put(tmp_path / "log", "a", ["Sample\tsite0", "0\t1.5,2.5;3,4\t", "1\t0.5,0;7,8"])
    samples.coverage_log(spark, str(tmp_path / "log"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert rows(spark, str(tmp_path / "t")) == [(0, 0, 0, 1.5, 2.5), (0, 0, 1, 3.0, 4.0), (1, 0, 0, 0.5, 0.0), (1, 0, 1, 7.0, 8.0)]


def test_taxa_by_name(spark):
    places = reads.taxon_places(spark.createDataFrame([("'b'",), ("a",), ('"c d"',)], "taxon string"))
    assert sorted(tuple(r) for r in places.collect()) == [("a", 0), ("b", 1), ("c d", 2)]
    named = spark.createDataFrame([("'a'", 1), ("c d", 2)], "name string, x int")
    assert sorted((r.x, r.place) for r in reads.matched_taxa(named, places).collect()) == [(1, 0), (2, 2)]
    with pytest.raises(Exception, match="Not a taxon: z"):
        reads.matched_taxa(named.withColumn("name", F.lit("z")), places).collect()
    with pytest.raises(ValueError, match="Repeated name a"):
        reads.taxon_places(spark.createDataFrame([("a",), ("'a'",)], "taxon string"))


def test_backgrounds_by_name(spark):
    found = reads.ordered_background(spark.createDataFrame([("coverage",), ("variant1",)], "name string"), full=False)
    assert sorted((r.name, r.place) for r in found.collect()) == [("coverage", 1), ("variant1", 0)]
    with pytest.raises(Exception, match="Not a background: variant2"):
        reads.ordered_background(spark.createDataFrame([("variant2",)], "name string"), full=False).collect()
