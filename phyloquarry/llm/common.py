"""Shared helpers of the corpus operators: table access, lineage cuts, word rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Unset, it is an error on a cluster; one machine (tests) gets a local one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found


def own_dir(spark: SparkSession) -> str:
    """This application's folder below ``shared_dir``."""
    return f"{shared_dir(spark)}/written-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors. See ``release``."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes all tables this application has written; call it when no result is read any more."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions, for explicit repartitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_bytes(text: Column) -> Column:
    """UTF-8 length as a long; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
