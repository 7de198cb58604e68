"""N-gram Jaccard self-join with Bayesian candidate pruning.

Equal texts form one class (a 128-bit digest of the text), and only one text of each class is compared. A text's set
is its shingles of five words (a shorter text is one shingle). Each set has HASHES MinHash values in BANDS bands;
texts that share a band meet in its bucket. A pair with similarity 0.8 misses all bands once in about 20 million.
Buckets with the same members are kept once, by their smallest band, and a pair is judged only in its smallest
common bucket. There, MinHash values are compared in steps; a pair is dropped once the posterior probability
(uniform prior) that its similarity reaches the threshold is below TOLERANCE, and what is left is verified on the
exact shingle sets.

Pairs are never rows. A bucket is split into blocks of about BLOCK members and a task sees two blocks; it returns
a row a member, with the sum of its links and a link to the smallest member it is tied to. So a group of near
copies costs rows in proportion to its members and blocks. Texts reach buckets by one shuffle that only texts
with a shared band survive.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, written
from .components import components
from .wordhash import U, Words, mix, parts

GRAM, THRESHOLD = 5, 0.8
HASHES, BANDS = 128, 32
ROWS = HASHES // BANDS
STEP, TOLERANCE = 32, 1e-6
BLOCK = 384
#: What a text with a word matches.
WORDED = r"[^\x20\x09-\x0D]"
#: Texts a task remembers so as not to repeat the bands of copies.
REMEMBERED = 200_000
#: A class of more than one in HOT_SHARES of a task's share of the rows is sent to the rows instead of shuffled with them.
HOT_SHARES = 4


@lru_cache(1)
def seeds() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20).integers(0, 1 << 63, (2, HASHES), dtype=np.int64).astype(U)
    return draw[0] | U(1), draw[1]


def shingle_sets(column: pa.Array, n: int = GRAM) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(column)
    runs = words.runs(n)
    out = []
    for a, b in zip(words.row[:-1], words.row[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            short = np.array([b - a], U)
            for i in range(a, b):
                short = mix(short * U(31) + words.hash[i : i + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, U))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima; the set must not be empty."""
    a, b = seeds()
    least = np.full(HASHES, np.iinfo(np.uint64).max, U)
    for i in range(0, len(shingles), 256):
        part = shingles[i : i + 256]
        np.minimum(least, (part[:, None] * a[None] + b[None]).min(0), out=least)
    return (mix(least) >> U(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U)[None], (len(signatures), BANDS))
    for r in range(ROWS):
        key = mix(key * U(0x2545F4914F6CDD1D) + signatures[:, r::ROWS].astype(U))
    return key


@lru_cache(1)
def least_matches() -> dict[int, int]:
    """For each number of values compared, the matches below which a pair is dropped.

    With a uniform prior the posterior is Beta(m+1, n-m+1), whose tail above t is a binomial's lower tail.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while (tail := tail + comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)) < TOLERANCE:
            m += 1
        out[n] = m
    return out


def survivors(sa: np.ndarray, sb: np.ndarray, ka: np.ndarray, kb: np.ndarray, band: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of rows of two blocks) that meet first in this band and outlive the pruning."""
    first = np.ones((len(sa), len(sb)), bool)
    if same:
        first = np.triu(first, 1)
    for k in range(band):
        first &= ka[:, k][:, None] != kb[:, k][None]
    i, j = np.nonzero(first)
    seen = np.zeros(len(i), np.int32)
    for n, least in least_matches().items():
        seen += (sa[i, n - STEP : n] == sb[j, n - STEP : n]).sum(1, dtype=np.int32)
        stay = seen >= least
        i, j, seen = i[stay], j[stay], seen[stay]
    return i, j


def verified(i: np.ndarray, j: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether each pair's exact Jaccard similarity reaches the threshold."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if len(i) <= 2 * (len(a) + len(b)):
        both = np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    else:
        ua, ub = sorted(set(i.tolist())), sorted(set(j.tolist()))
        codes, inverse = np.unique(np.concatenate([*(a[x] for x in ua), *(b[y] for y in ub)]), return_inverse=True)
        row = np.repeat(np.arange(len(ua) + len(ub)), np.concatenate([la[ua], lb[ub]]))
        order = np.argsort(inverse, kind="stable")
        inverse, row = inverse[order], row[order]
        total = np.zeros((len(ua), len(ub)), np.float32)
        for at in range(0, len(codes), 4096):
            x, y = np.searchsorted(inverse, [at, at + 4096])
            dense = np.zeros((len(ua) + len(ub), 4096), np.float32)
            dense[row[x:y], inverse[x:y] - at] = 1
            total += dense[: len(ua)] @ dense[len(ua) :].T
        both = total[np.searchsorted(ua, i), np.searchsorted(ub, j)].astype(np.int64)
    return 10 * both >= 8 * (la[i] + lb[j] - both)


def judge(band: int, ids: list[bytes], sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool) -> tuple[list, list, list]:
    """(ids, links, roots) of the members with links between the rows ``left`` and ``right`` of one bucket."""
    signatures = np.array([signature(s) for s in sets])
    keys = band_keys(signatures)
    sl, sr = signatures[left], signatures[right]
    kl, kr = keys[left], keys[right]
    own = [sets[x] for x in left], [sets[x] for x in right]
    links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    rank = np.argsort(np.argsort(np.array(ids, dtype=object), kind="stable"), kind="stable")
    for at in range(0, len(left), 128):
        i, j = survivors(sl[at : at + 128], sr[0 if not same else at :], kl[at : at + 128], kr[0 if not same else at :], band, same)
        if not len(i):
            continue
        good = verified(i, j, own[0][at : at + 128], own[1][0 if not same else at :])
        x, y = left[i[good] + at], right[j[good] + (at if same else 0)]
        np.add.at(links, x, sizes[y])
        np.add.at(links, y, sizes[x])
        for u, v in zip(x.tolist(), y.tolist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                u, v = (u, v) if rank[u] < rank[v] else (v, u)
                parent[v] = u
    tied = np.flatnonzero(links)
    return [ids[x] for x in tied], links[tied].tolist(), [ids[root(x)] for x in tied]


def text_class(text_col: str):
    return F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))


def similar_classes(docs: DataFrame) -> DataFrame:
    """(class, links, root) rows for the text classes of ``docs`` (class, id, text) with verified links.

    ``links`` adds up, over a class's rows, the sizes of all similar classes; (class, root) are edges that connect
    what is similar. One row of each class, that of its smallest id, brings the text.
    """
    n = partitions(docs.sparkSession)

    def bands(batches):
        seen: set = set()
        for whole in batches:
            for batch in parts(whole, 1):
                classes, found = batch.column(0).to_pylist(), shingle_sets(batch.column(1))
                fresh = []
                for i, (c, s) in enumerate(zip(classes, found, strict=True)):
                    if len(s) and c not in seen:
                        seen.add(c)
                        fresh.append(i)
                if len(seen) > REMEMBERED:
                    seen.clear()
                if fresh:
                    keys = band_keys(np.array([signature(found[i]) for i in fresh]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(fresh))), pa.array(keys.ravel().view(np.int64)), pa.array([classes[i] for i in fresh for _ in range(BANDS)], pa.binary())],
                        ["band", "key", "class"],
                    )

    rows = written(docs.select("class", "text").mapInArrow(bands, "band int, key bigint, class binary").distinct())
    buckets = rows.groupBy("key").agg(F.first("band").alias("band"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("class")).alias("who"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("who2"))
    kept = buckets.where("n > 1").groupBy("n", "who", "who2").agg(F.min(F.struct("band", "key")).alias("b"))
    kept = kept.select("b.key", "n")
    classes = docs.groupBy("class").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    member = rows.join(kept, "key").groupBy("class").agg(F.collect_list(F.struct("key", "band", "n")).alias("buckets"))  # BANDS at most
    member = member.join(classes, "class")
    texts = docs.join(member, ["class", "id"]).dropDuplicates(["class", "id"]).select("class", "size", "text", F.xxhash64("class").alias("h"), F.inline("buckets"))
    blocks = F.ceil(F.col("n") / BLOCK)
    texts = texts.withColumn("own", F.pmod("h", blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    texts = texts.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "band", "class", "size", "own", "text")
    texts = texts.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b")

    def solve(batches):
        def group(rows_: list) -> list:
            (_, a, b), band = rows_[0][0], rows_[0][1]
            own = np.array([r[4] for r in rows_])
            left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
            if len(left) and len(right) and (a != b or len(left) > 1):
                return list(zip(*judge(band, [r[2] for r in rows_], np.array([r[3] for r in rows_], np.int64), [r[5] for r in rows_], left, right, a == b), strict=True))
            return []

        rows_: list = []
        for whole in batches:
            out = []
            for batch in parts(whole, 7):
                found = shingle_sets(batch.column(7))
                key, a, b, band, ids, size, own = (c.to_pylist() for c in batch.columns[:7])
                for i, s in enumerate(found):
                    at = (key[i], a[i], b[i])
                    if rows_ and rows_[0][0] != at:
                        out += group(rows_)
                        rows_ = []
                    rows_.append((at, band[i], ids[i], size[i], own[i], s))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("class", "links", "root"), r, strict=True)) for r in out], schema=answer)
        if rows_ and (out := group(rows_)):
            yield pa.RecordBatch.from_pylist([dict(zip(("class", "links", "root"), r, strict=True)) for r in out], schema=answer)

    answer = pa.schema([("class", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])
    return texts.mapInArrow(solve, "class binary, links bigint, root binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``text_class``, ``copy_of``, ``class_id``, ``n_links``, ``stays``) for each row of ``docs``.

    ``text_class`` is a digest of the text, ``copy_of`` the smallest id with the same text, ``class_id`` the smallest
    id in the connected group of similar texts, ``n_links`` the number of other rows with the same or a similar text.
    ``stays`` marks the row of each group that represents it: the text of the smallest id (of several texts with
    that id, the one with the smallest digest). A null text or one without words is similar to nothing, not even to
    its like; such a row (``text_class`` null), and one with a null id, is its own class without links and stays.
    Rows may share an id: groups are made of texts, so two unlike texts with one id stay apart; rows that share id
    and text are copies of each other and stay or go together. Empty tables give no rows; other columns are not
    carried.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    worded = F.when(F.col("text").rlike(WORDED), text_class("text"))
    known = "class is not null and id is not null"
    judged = docs.select(worded.alias("class"), "id", "text").where(known)
    rows = written(docs.select("id", worded.alias("class")))
    named = rows.where(known)
    found = written(similar_classes(judged))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class").alias("u"), F.col("root").alias("v")))
    classes = named.groupBy("class").agg(F.min("id").alias("copy_of"), F.count(F.lit(1)).alias("size"))
    tied = classes.join(roots.withColumnRenamed("node", "class"), "class").select("class", "copy_of", "root")
    first = tied.groupBy("root").agg(F.min(F.struct("copy_of", "class")).alias("first"))
    tied = tied.join(first, "root").select("class", F.col("first.copy_of").alias("class_id"), (F.col("first.class") == F.col("class")).alias("leads"))
    classes = classes.join(links, "class", "left").join(tied, "class", "left")
    classes = written(classes.select("class", "size", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"), F.coalesce("leads", F.lit(True)).alias("leads"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    is_hot = F.col("size") * (HOT_SHARES * partitions(docs.sparkSession)) > total
    hot = F.broadcast(classes.where(is_hot))  # classes of more than a share of the rows: fewer than there are shares
    cold = named.join(hot.select("class"), "class", "left_anti").join(classes.where(~is_hot), "class")
    joined = named.join(hot, "class").unionByName(cold).select("id", F.hex("class").alias("text_class"), "copy_of", "class_id", F.col("n_links").cast("long").alias("n_links"), (F.col("leads") & (F.col("id") == F.col("copy_of"))).alias("stays"))
    alone = rows.where("class is null or id is null").select("id", F.hex("class").alias("text_class"), F.col("id").alias("copy_of"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("stays"))
    return joined.unionByName(alone).withColumnRenamed("id", id_col)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: each one's class and number of links."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "copy_of", "class_id", "n_links")


QUERIES = {"op6_jaccard_join": (op6_jaccard_join, None)}
