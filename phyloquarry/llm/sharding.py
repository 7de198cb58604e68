"""Proportional stratified interleaving: shards that each match the source mixture.

Rows are shuffled by a seeded hash, ranked within their source, put in the order of their fractional rank
(2r-1)/2n and cut into equal runs. Every run then holds each source in proportion, to within one row a cut.

Ranks are taken in two levels so that no window spans a whole source: about sqrt(N) hash buckets a source, a
row_number inside each bucket and a running total over bucket counts. The global order uses about sqrt(N)
buckets of the fractional rank in the same way. A source with a third of all rows is thus many groups, and no
task or running total sees more than about sqrt(N) rows at once. Ranks are taken on narrow columns; documents are
numbered, written once and joined with their places, so their text is shuffled once.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, utf8_bytes, written

HASH_BITS = 60


def stratified_shards(docs: DataFrame, n_shards: int = 16, seed: str = "shard", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns of ``docs`` with ``shard`` (0 .. n_shards-1) and gapless ``slot`` (0 ..) of each row.

    Shard sizes are at most one row apart. Columns named ``shard`` or ``slot`` are replaced, all others kept; text
    is no special case, so nulls, empty and long texts are rows like any other. A null source is a stratum of its
    own. Rows with an equal id, repeated rows among them, are separate rows in the order of the numbers they are
    written with, so that a repeated task gives the same places; rows with a null id are shuffled by that number.
    An empty table gives no rows.
    """
    row = F.monotonically_increasing_id()
    numbered = written(docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    n = numbered.count()
    buckets = isqrt(n) + 1
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null "), F.col("row").cast("string")))))
    rows = numbered.select(
        "row",
        "id",
        F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("source "), F.col("source").cast("string"))).alias("stratum"),
        F.conv(F.substring(seeded, 1, HASH_BITS // 4), 16, 10).cast("long").alias("key"),
    ).withColumn("bucket", F.floor(F.shiftright("key", HASH_BITS - 30) * F.lit(buckets) / F.lit(1 << 30)))
    counts = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    per_source = Window.partitionBy("stratum")
    counts = counts.select(
        "stratum",
        "bucket",
        (F.sum("n").over(per_source.orderBy("bucket")) - F.col("n")).alias("before"),
        F.sum("n").over(per_source).alias("in_source"),
    )
    ranked = rows.withColumn("in_bucket", F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("key", "id", "row")))
    ranked = ranked.join(counts, ["stratum", "bucket"]).withColumn("odd", 2 * (F.col("before") + F.col("in_bucket")) - 1)
    ranked = ranked.withColumn("fraction", F.col("odd") / (2 * F.col("in_source"))).withColumn("slice", F.floor(F.col("fraction") * buckets))
    slices = ranked.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    slices = slices.select("slice", (F.sum("n").over(Window.orderBy("slice")) - F.col("n")).alias("first"))
    ordered = Window.partitionBy("slice").orderBy("fraction", "key", "id", "row")
    placed = ranked.withColumn("in_slice", F.row_number().over(ordered)).join(slices, "slice")
    placed = placed.withColumn("position", F.col("first") + F.col("in_slice") - 1)
    total = max(n, 1)
    shard = F.expr(f"(position * {n_shards}) div {total}")
    places = placed.select("row", shard.cast("int").alias("shard"), "position")
    slot = F.expr(f"position - (shard * {total}L + {n_shards - 1}) div {n_shards}")
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return numbered.select("row", "doc").join(places, "row").select(*kept, "shard", slot.alias("slot"))


def op2_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 15 under the law ``rows``; the method has no groups of equal texts."""
    placed = stratified_shards(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    size, crc = utf8_bytes(F.col("text")) + 1, F.crc32(F.coalesce(F.col("text"), F.lit("")))
    return placed.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


ORACLE = """
WITH RECURSIVE steps AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
docs AS (SELECT doc_id, source, coalesce(text, '') AS text, coalesce(octet_length(encode(text)), 0) + 1 AS size,
    ('0x' || substr(md5('shard:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key FROM documents),
sums AS (SELECT docs.*, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS text_crc32 FROM docs, crc),
ranked AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY key, doc_id) - 1)::DOUBLE
    / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS fraction FROM sums),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, key, doc_id) - 1 AS position, count(*) OVER () AS n FROM ranked),
cut AS (SELECT *, (position * 16) // n AS sh FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, sh::INT AS shard,
  (position - (sh * n + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard, source FROM cut
"""

QUERIES = {"op2_stratified_sharding": (op2_stratified_sharding, ORACLE)}
