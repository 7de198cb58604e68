"""Running estimates of a trace that is still being written, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "sample bigint, var string, value double"


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (sample, var, value) from the Parquet files of a growing folder."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def running_estimates(stream: DataFrame) -> DataFrame:
    """(var, n, mean, low, high) so far; the state is one row a variable."""
    return stream.groupBy("var").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
