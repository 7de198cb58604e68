"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

A benchmark item gives windows of ten consecutive words (one window if it is shorter). A window is a sequence
of shingles of three words; since it must be contained whole, one shingle is a necessary prefix.

1. Rarity: one scan counts how often each of the benchmark's shingles occurs in the documents; only keys and counts
   leave a task. Each window keeps its rarest shingle as prefix; a window with a shingle that never occurs is dropped.
2. Prefix join: a second scan keeps the occurrences of prefixes, each with the few words that a window over it can
   touch (17 at most), and joins them with the windows. Length and positional bounds drop the impossible, and the
   words are compared one by one with the window's.

In both scans a bitmap of the wanted keys' hashes drops nearly all positions at once, before any of them is widened
or shuffled; it has about BITS_A_KEY bits a key and MOST_BITS (8 MB) at most, beyond which it drops fewer. Joins are
left to Spark, which broadcasts a side only if it has measured it as small and else shuffles both. Document text is
never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WINDOW, SHINGLE = 10, 3
#: Bits of the bitmap for each key, and the least and most of them; powers of two.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 64, 1 << 10, 1 << 26

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII characters that part words, once A-Z are lower case.
PARTING = "".join(chr(c) for c in range(1, 128) if not (chr(c).isdigit() or chr(c).isalpha()))


def words(text: Column) -> Column:
    """Words of the text with A-Z lowered: runs of digits, a-z and characters beyond ASCII. Null has none."""
    spaced = F.translate(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\0"), F.lit(" ")), UPPER + PARTING, UPPER.lower() + " " * len(PARTING))
    return F.array_remove(F.split(spaced, " "), "")


def row_key(id_col: str, text_col: str) -> Column:
    """What stands for a row: its id with 128 bits of id and text. Rows alike in both are alike in all that follows."""
    own = [F.col(id_col), F.col(text_col).cast("string")]
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.lit(1), *own).alias("a"), F.xxhash64(F.lit(2), *own).alias("b"))


def shingle_key(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, length: int) -> DataFrame:
    """(wid, window, items): distinct windows with the ids of their items as strings; items without id or words give none."""
    found = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    found = found.where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (length - 1), F.lit(1)))
    found = found.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), length).alias("window"))
    return found.groupBy("window").agg(F.collect_set("item").alias("items")).withColumn("wid", F.sha2(F.concat_ws(" ", "window"), 256))


def among(keys: DataFrame):
    """A test for columns of keys: whether a key may be in ``keys`` (key). Some that are not pass, none that is fails."""
    n = BITS_A_KEY * max(keys.count(), 1)
    bits = min(max(1 << n.bit_length(), LEAST_BITS), MOST_BITS)
    place = lambda key: F.shiftrightunsigned(key, 20).bitwiseAND(F.lit(bits - 1))
    cell = lambda key: F.shiftright(place(key), 6).cast("int")
    bit = lambda key: place(key).bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("key")))
    cells = keys.groupBy(cell(F.col("key")).cast("long").alias("id")).agg(F.bit_or(one).alias("v"))
    dense = keys.sparkSession.range(bits // 64).join(cells, "id", "left")
    listed = F.array_sort(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))))
    bitmap = written(dense.agg(F.transform(listed, lambda x: x["v"]).alias("bitmap"))).scalar()
    return lambda key: F.getbit(F.get(bitmap, cell(key)), bit(key)) == 1


def shingled(docs: DataFrame, g: int, wanted) -> DataFrame:
    """(doc, w, at, key): the shingles of ``g`` words at word ``at`` that pass ``wanted``, in a document's words ``w``."""
    columns = [F.col("w"), *(F.slice("w", k, F.size("w")) for k in range(2, g + 1))]
    rows = docs.where(F.size("w") >= g).select("doc", "w", F.posexplode(F.arrays_zip(*[c.alias(f"c{k}") for k, c in enumerate(columns)])).alias("at", "z"))
    key = shingle_key([F.col(f"z.c{k}") for k in range(g)])
    return rows.where(F.col(f"z.c{g - 1}").isNotNull()).select("doc", "w", "at", key.alias("key")).where(wanted(F.col("key")))


def contaminated_words(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Occurrences of benchmark windows, verified word by word.

    Returns (windows, found): windows as (wid, window, items) and found as (doc, at, len, wid), a row for each
    occurrence; ``doc`` is the row's ``row_key``. Null or wordless texts have no windows; rows alike in id and text
    count once; empty tables give no rows; other columns play no part.
    """
    windows = written(benchmark_windows(items, item_col, item_text_col, length))
    split_docs = docs.select(row_key(id_col, text_col).alias("doc"), words(F.col(text_col)).alias("w"))
    sizes = [r.g for r in windows.select(F.least(F.size("window"), F.lit(SHINGLE)).alias("g")).distinct().collect()]  # SHINGLE at most
    found = None
    for g in sorted(sizes):
        own = windows.where(F.least(F.size("window"), F.lit(SHINGLE)) == g).select("wid", "window")
        offsets = F.sequence(F.lit(0), F.size("window") - g)
        shingles = own.select("wid", "window", F.explode(offsets).alias("offset"))
        shingles = written(shingles.select("wid", "window", "offset", shingle_key([F.element_at("window", F.col("offset") + k) for k in range(1, g + 1)]).alias("key")))
        rarity = shingled(split_docs, g, among(shingles.select("key").distinct())).groupBy("key").agg(F.count(F.lit(1)).alias("seen"))
        ordered = shingles.join(rarity, "key", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
        prefix = ordered.groupBy("wid").agg(F.min(F.struct("seen", "key", "offset")).alias("p")).where("p.seen > 0")
        prefix = written(prefix.select("wid", "p.key", "p.offset").join(own, "wid"))
        base = F.greatest(F.col("at") - (length - g), F.lit(0))
        hits = shingled(split_docs, g, among(prefix.select("key").distinct()))
        hits = hits.select("doc", "key", "at", F.size("w").alias("n"), F.slice("w", base + 1, 2 * length - g).alias("around"), base.alias("base"))
        candidates = hits.join(prefix, "key").withColumn("start", F.col("at") - F.col("offset"))
        bounded = candidates.where((F.col("start") >= 0) & (F.col("start") + F.size("window") <= F.col("n")))
        exact = bounded.where(F.slice("around", F.col("start") - F.col("base") + 1, F.size("window")) == F.col("window"))
        exact = exact.select("doc", F.col("start").alias("at"), F.size("window").alias("len"), "wid").distinct()
        found = exact if found is None else found.unionByName(exact)
    if found is None:
        kind = docs.schema[id_col].dataType.simpleString()
        found = docs.sparkSession.createDataFrame([], f"doc struct<id:{kind}, a:bigint, b:bigint>, at int, len int, wid string")
    return windows, found


def decontamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``n_hit``, ``n_items``, ``item_ids`` (sorted strings), ``contaminated``.

    Null has no words, nor has an empty text; long texts are taken whole. Each row is judged by its own text, whether
    others share its id and whether it has one or not. Repeated rows stay rows; an empty table gives none, an empty
    benchmark hits nothing; other columns play no part.
    """
    windows, found = contaminated_words(docs, items, id_col, text_col, item_col, item_text_col, length)
    found = written(found)
    before = Window.partitionBy("doc").orderBy("at", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("len")
    covered = found.withColumn("reach", F.coalesce(F.max(end).over(before), F.lit(0)))
    covered = covered.groupBy("doc").agg(F.sum(F.greatest(end - F.greatest("at", "reach"), F.lit(0))).cast("long").alias("n_hit"))
    named = found.select("doc", "wid").distinct().join(windows.select("wid", "items"), "wid")
    named = named.groupBy("doc").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    hit = covered.join(named, "doc").select(F.col("doc.a").alias("a"), F.col("doc.b").alias("b"), "n_hit", "item_ids")
    all_docs = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("doc"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    joined = all_docs.select("id", F.col("doc.a").alias("a"), F.col("doc.b").alias("b"), "n_words").join(hit, ["a", "b"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``."""
    found = decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, unnest(CASE WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS g FROM bw),
dw AS (SELECT doc_id, pos, g, w[pos:pos + g - 1] AS win FROM (SELECT doc_id, w, g, unnest(range(1, len(w) - g + 2)) AS pos FROM d, sizes WHERE len(w) >= g)),
hit AS (SELECT doc_id, pos, g, item_id FROM dw JOIN bw USING (win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + g)) AS p FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

QUERIES = {"op9_benchmark_decontamination": (op9_benchmark_decontamination, ORACLE)}
