"""Places of rows inside keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import kept

PLACE, ALL = "_rank", "_all"
#: Tasks that the rows of one key are spread over where they meet a value of their key.
SALTS = 16


def met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which null meets null; the keys come once."""
    named = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(named[f"_of_{k}"])
    return left.join(named, same).drop(*[f"_of_{k}" for k in keys])


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with each row's place in its key (``_rank``, 1 on) and the number of the key's rows (``_all``).

    Rows are parted once by ranges of keys and order, so one key spreads over as many tasks as it fills; a part's rows
    are numbered after those of the key's parts before it. Only counts, a row for each key and part, meet by key.
    Rows alike in keys and order share a part and are numbered as they come.
    """
    parted = kept(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = parted.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = counts.select(*keys, "_part", (F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias(ALL))
    inside = parted.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    return met(inside, before, [*keys, "_part"]).withColumn(PLACE, F.col("_before") + F.col("_in")).drop("_part", "_before", "_in")


def running(df: DataFrame, keys: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """``df`` with the sums over the key's earlier rows (``_before_x``) and over all of them (``_all_x``).

    Parted as in ``numbered``: sums are taken inside ranges and, a row for each key and range, between them.
    """
    parted = kept(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    parts = parted.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    whole = Window.partitionBy(*keys)
    up = whole.orderBy("_part")
    before = parts.select(*keys, "_part", *[(F.sum(f"_sum_{c}").over(up) - F.col(f"_sum_{c}")).alias(f"_until_{c}") for c in sums], *[F.sum(f"_sum_{c}").over(whole).alias(f"_all_{c}") for c in sums])
    earlier = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = parted
    for c in sums:
        inside = inside.withColumn(f"_in_{c}", F.coalesce(F.sum(c).over(earlier), F.lit(0)))
    out = met(inside, before, [*keys, "_part"])
    for c in sums:
        out = out.withColumn(f"_before_{c}", F.col(f"_until_{c}") + F.col(f"_in_{c}"))
    return out.drop("_part", *[f"_{x}_{c}" for c in sums for x in ("until", "in")])


def with_key_values(df: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the one row of ``values`` for its key. Rows of a key are spread over SALTS tasks and more of its values sent there."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)))
    copies = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return met(salted, copies, [*keys, "_salt"]).drop("_salt")


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, median) of finite values. Equal values are counted first, so one that many rows share is one row."""
    finite = df.where(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    counted = finite.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counted, keys, [value], ["_n"])
    at = lambda place: F.max(F.when((place > F.col("_before__n")) & (place <= F.col("_before__n") + F.col("_n")), F.col(value)))
    low, high = at(F.floor((F.col("_all__n") + 1) / 2)), at(F.ceil((F.col("_all__n") + 1) / 2))
    return placed.groupBy(*keys).agg(F.sum("_n").alias("n"), (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"), ((low + high) / 2).alias("median"))
