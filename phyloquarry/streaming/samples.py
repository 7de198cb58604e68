"""Sample logs as they arrive: genotype and coverage samples appended to a partitioned table, each row once.

Every batch of the stream is written to a partition of its own, named by the batch's number, and a batch that is run again
after a failure overwrites its own partition and nothing else. The stream's checkpoint says which batch comes next, so a
restarted stream goes on where it stopped, and readers see each sample once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.text import coverage_rows, state_rows

BATCH = "batch"


def log_lines(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of (value), the lines of text files that a sampler puts into a folder."""
    reader = spark.readStream if files_a_batch is None else spark.readStream.option("maxFilesPerTrigger", files_a_batch)
    return reader.text(folder)


def appended(stream: DataFrame, table: str, checkpoint: str, rows: Callable[[DataFrame], DataFrame] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts appending ``rows(batch)`` to the Parquet folder ``table``; ``trigger`` as for ``writeStream``.

    ``checkpoint`` is a folder that driver and executors share and belongs to this table alone.
    """

    def put(batch: DataFrame, number: int) -> None:
        own = rows(batch) if rows else batch
        own.write.mode("overwrite").parquet(f"{table}/{BATCH}={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def genotype_log(spark: SparkSession, folder: str, table: str, checkpoint: str, files_a_batch: int | None = None) -> StreamingQuery:
    """Appends (sample, place, cell, genotype, ado) of the sampled lines in ``folder``."""
    return appended(log_lines(spark, folder, files_a_batch), table, checkpoint, state_rows)


def coverage_log(spark: SparkSession, folder: str, table: str, checkpoint: str, files_a_batch: int | None = None) -> StreamingQuery:
    """Appends (sample, place, category, cov, var) of the sampled lines in ``folder``."""
    return appended(log_lines(spark, folder, files_a_batch), table, checkpoint, coverage_rows)


def samples(spark: SparkSession, table: str) -> DataFrame:
    """The rows appended so far, without the batch number."""
    return spark.read.parquet(table).drop(BATCH)
