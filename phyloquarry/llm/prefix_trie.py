"""Conversation prefix trie: what conversations share from their first turn on, as succinct tries of prefix shards.

1. Turns become 128-bit hashes and byte lengths; text is never shuffled. A turn's place is counted over sorted ranges,
   so a conversation of any length is spread over tasks.
2. A prefix is known by the running exclusive-or of (place, turn) hashes, and its node by an aggregate over it: the
   smallest member, the number of members, the bytes of its last turn.
3. Nodes with the same members follow each other and share (smallest member, members): they make one edge of the
   trie, however many turns it has. There are at most two edges a distinct conversation.
4. An edge with at most ``sqrt(conversations)`` members (LEAST_LIGHT at least) is light. The light subtrees are found
   by pointer doubling and dealt to shards. In each, numpy lays the edges out in level order as a LOUDS bitvector with
   an array of labels, and the sums over subtrees are taken level by level from the deepest with ``add.at``.
5. The heavy upper levels are merged apart: they get the sums of the light subtrees below them, and sum over each
   other by pointer doubling, in as many rounds as the logarithm of their depth.
6. Nodes get their edge's sums, less what stands above them on the edge.

No group that grows with the table meets in one task: an edge's nodes are cut into blocks of BLOCK turns, and a parent of
many edges is joined by a broadcast of such parents (fewer than four a shuffle partition). The digest of the ids
that end at a node is a hash of one text in order, so one task streams it, from packed blocks of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table, utf8_bytes, written

#: Turns of one conversation or edge that a task may see together.
BLOCK = 4096
#: Members up to which an edge is light, whatever the size of the table; edges a shard holds, if its subtrees are even.
LEAST_LIGHT, SHARD_EDGES = 256, 200_000
FAMILY, MOST_SHARED = 5, 8
KEY = ["depth", "fa", "fb"]
EDGE = ["m", "n"]


class Louds:
    """A forest below one root in level order: for each node a one for each child, then a zero; node 0 is the root."""

    def __init__(self, parent: np.ndarray, label: np.ndarray):
        """``parent`` of each given node, -1 for the topmost; siblings are put in the order of their labels."""
        n = len(parent)
        by_parent = np.lexsort((label, parent))
        first = np.searchsorted(parent[by_parent], np.arange(-1, n + 1))
        children = first[1:] - first[:-1]
        level, order, self.levels, at = np.array([-1], np.int64), [], [], 1
        while len(level):
            counts = children[level + 1]
            starts = np.repeat(first[level + 1] - np.cumsum(counts) + counts, counts)
            level = by_parent[starts + np.arange(counts.sum())]
            if len(level):
                order.append(level)
                self.levels.append((at, at + len(level)))
                at += len(level)
        #: The given number of each node but the root.
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.labels = label[self.order]
        degrees = children[np.concatenate([[-1], self.order]).astype(np.int64) + 1]
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[np.cumsum(degrees) + np.arange(n + 1)] = False

    def parents(self) -> np.ndarray:
        """The parent of each node but the root: the zeros before its one."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def degrees(self) -> np.ndarray:
        """The number of children of each node, the root's first."""
        ends = np.flatnonzero(~self.bits)
        return np.diff(np.concatenate([[-1], ends])) - 1

    def rollup(self, own: np.ndarray) -> np.ndarray:
        """``own`` (of nodes in level order, the root's first) summed over subtrees, the deepest level first."""
        total, parent = own.copy(), self.parents()
        for low, high in reversed(self.levels):
            np.add.at(total, parent[low - 1 : high - 1], total[low:high])
        return total


def _shard_trie(frame: pd.DataFrame) -> tuple[Louds, pd.DataFrame]:
    """The trie of a shard's edges (m, n, pm, pn, label), and the edges in its order."""
    frame = frame.reset_index(drop=True)
    own = pd.MultiIndex.from_arrays([frame["m"], frame["n"]])
    trie = Louds(own.get_indexer(pd.MultiIndex.from_arrays([frame["pm"], frame["pn"]])), frame["label"].to_numpy(np.int64))
    return trie, frame.iloc[trie.order]


def _shard_sums(frame: pd.DataFrame) -> pd.DataFrame:
    trie, edges = _shard_trie(frame)
    kids = trie.degrees()
    leaves = trie.rollup((kids == 0).astype(np.int64))
    saved = trie.rollup(np.concatenate([[0], edges["own"].to_numpy(np.int64)]))
    return pd.DataFrame({"m": edges["m"], "n": edges["n"], "leaves": leaves[1:], "saved": saved[1:], "kids": kids[1:].astype(np.int64)})


def _shard_rows(frame: pd.DataFrame) -> pd.DataFrame:
    trie, edges = _shard_trie(frame)
    ends = [edges[c].to_numpy(np.int64) for c in ("m", "bottom")]
    return pd.DataFrame({"shard": frame["shard"].iloc[:1], "n_nodes": len(edges) + 1, "louds": np.packbits(trie.bits).tobytes(), "labels": [trie.labels], "conv_id": [ends[0]], "depth": [ends[1]]})


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, rank, a, b, bytes): each turn's place in its conversation (1 ..), hash and bytes; rows without id are left out."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    own = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"),
        utf8_bytes(text).alias("bytes"),
        F.monotonically_increasing_id().alias("salt"),
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "a", "b", "salt"]
    own = own.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    numbered = written(own.select("conv", "a", "b", "bytes", F.monotonically_increasing_id().alias("at")))
    numbered = numbered.withColumn("part", F.shiftright("at", 33))
    spans = numbered.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv", "part", "first", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"))
    return numbered.join(spans, ["conv", "part"]).select("conv", (F.col("at") - F.col("first") + F.col("before") + 1).alias("rank"), "a", "b", "bytes")


def rebuilt(ranked: DataFrame, family: int = FAMILY, most_shared: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: (rows, convs).

    Conversation c takes the first h turns of conversation c - c % ``family`` and its own after the first h, h being
    crc32(c) % (``most_shared`` + 1). Rows are (conv, depth, a, b, bytes), convs (conv, length).
    """
    convs = ranked.groupBy("conv").agg(F.max("rank").alias("turns"))
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % family).withColumn("h", F.crc32(F.col("conv").cast("string")) % (most_shared + 1))
    bases = convs.where("conv = base").select("base", F.col("turns").alias("shared"))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("shared", F.lit(0))))
    convs = written(convs.select("conv", "base", "h", "k", (F.col("k") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("length")))
    # h follows from the id, so rows need only the k of conversations whose base is short or absent, block by block
    blocks = F.sequence(F.floor((F.col("h") + 1) / BLOCK), F.floor((F.col("length") - F.col("k") + F.col("h")) / BLOCK))
    short = convs.where("k < h and length > k").select("conv", "k", F.explode(blocks).alias("block"))
    own = ranked.withColumn("h", F.crc32(F.col("conv").cast("string")) % (most_shared + 1)).where("rank > h")
    own = own.withColumn("block", F.floor(F.col("rank") / BLOCK)).join(short, ["conv", "block"], "left")
    own = own.select("conv", (F.col("rank") - F.col("h") + F.coalesce("k", "h")).alias("depth"), "a", "b", "bytes")
    heads = ranked.where((F.col("rank") <= most_shared) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "base")
    heads = heads.join(convs.select("conv", "base", "k"), "base").where("rank <= k").select("conv", F.col("rank").alias("depth"), "a", "b", "bytes")
    return own.unionByName(heads), convs.select("conv", "length")


def running(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, fa, fb, la, lb, bytes): each prefix's hash, and what its last turn adds to it."""
    rows = rows.select("conv", "depth", F.xxhash64("depth", "a", "b").alias("la"), F.xxhash64("depth", "b", "a").alias("lb"), "bytes", F.floor(F.col("depth") / BLOCK).alias("block"))
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.select("conv", "block", "depth", "la", "lb", "bytes", *(F.bit_xor(c).over(inside).alias(f"f{c[1]}") for c in ("la", "lb")))
    long = convs.where(F.col("length") >= BLOCK).select("conv")
    totals = rows.join(long, "conv", "left_semi").groupBy("conv", "block").agg(F.bit_xor("la").alias("la"), F.bit_xor("lb").alias("lb"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "block", *(F.bit_xor(c).over(earlier).alias(f"{c}_before") for c in ("la", "lb")))
    plus = lambda c: F.col(f"f{c[1]}").bitwiseXOR(F.coalesce(f"{c}_before", F.lit(0))).alias(f"f{c[1]}")
    return found.join(totals, ["conv", "block"], "left").select("conv", "depth", plus("la"), plus("lb"), "la", "lb", "bytes")


def to_parents(rows: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with their one row of ``parents``, which many rows may share: such parents are broadcast."""
    most = partitions(rows.sparkSession) * 4
    hot = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("c"))
    total = rows.count()
    hot = F.broadcast(written(hot.where(F.col("c") * most > total).select(*on)))  # fewer than ``most`` rows
    some = rows.join(hot, on, "left_semi").join(F.broadcast(parents.join(hot, on, "left_semi")), on)
    return rows.join(hot, on, "left_anti").join(parents, on).unionByName(some)


def edges_of(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, spans): edges (m, n, top, bottom, own, label, pm, pn), and for each block of an edge the bytes before it."""
    block = F.floor(F.col("depth") / BLOCK).alias("block")
    top = F.min(F.struct("depth", "pa", "pb", "la")).alias("t")
    spans = written(nodes.groupBy(*EDGE, block).agg(top, F.max("depth").alias("bottom"), F.sum("bytes").alias("bytes")))
    edges = spans.groupBy(*EDGE).agg(F.min("t").alias("t"), F.max("bottom").alias("bottom"), F.sum("bytes").alias("bytes"))
    edges = written(edges.select(*EDGE, F.col("t.depth").alias("top"), "bottom", ((F.col("n") - 1) * F.col("bytes")).alias("own"), F.col("t.la").alias("label"), (F.col("t.depth") - 1).alias("depth"), F.col("t.pa").alias("fa"), F.col("t.pb").alias("fb")))
    above = to_parents(edges.where("top > 0"), nodes.select(*KEY, F.col("m").alias("pm"), F.col("n").alias("pn")), KEY).drop(*KEY)
    root = edges.where("top = 0").drop(*KEY).withColumns({"pm": F.lit(None).cast("long"), "pn": F.lit(None).cast("long")})
    earlier = Window.partitionBy(*EDGE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before")
    return written(above.unionByName(root)), spans.select(*EDGE, "block", before)


def light_shards(edges: DataFrame, light: int) -> DataFrame:
    """The light edges with their shard: all edges below one topmost light edge are in the same."""
    spark = edges.sparkSession
    below = written(edges.where(F.col("n") <= light))
    inner = F.col("pn") <= light
    points = written(below.select(*EDGE, F.when(inner, F.col("pm")).otherwise(F.col("m")).alias("rm"), F.when(inner, F.col("pn")).otherwise(F.col("n")).alias("rn")))
    while True:
        ahead = points.select(F.col("m").alias("rm"), F.col("n").alias("rn"), F.col("rm").alias("rm2"), F.col("rn").alias("rn2"))
        moved = written(points.join(ahead, ["rm", "rn"]))  # at most ``light`` edges point at one
        points = moved.select(*EDGE, F.col("rm2").alias("rm"), F.col("rn2").alias("rn"))
        if not moved.where("rm <> rm2 or rn <> rn2").take(1):
            break
    shards = max(partitions(spark), below.count() // SHARD_EDGES)
    return below.join(points, EDGE).withColumn("shard", F.pmod(F.xxhash64("rm", "rn"), F.lit(shards))).drop("rm", "rn")


def heavy_sums(edges: DataFrame, sums: DataFrame, light: int) -> DataFrame:
    """(m, n, leaves, saved, kids) of the heavy edges: their own, the light subtrees' and by doubling each other's."""
    heavy = edges.where(F.col("n") > light)
    kids = edges.groupBy("pm", "pn").agg(F.count(F.lit(1)).alias("kids"))
    tops = edges.where((F.col("n") <= light) & (F.col("pn") > light)).join(sums.select(*EDGE, "leaves", "saved"), EDGE)
    tops = tops.groupBy("pm", "pn").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    under = kids.join(tops, ["pm", "pn"], "left").select(F.col("pm").alias("m"), F.col("pn").alias("n"), "kids", "leaves", "saved")
    zero = lambda c: F.coalesce(c, F.lit(0))
    first = heavy.join(under, EDGE, "left").select(
        *EDGE,
        zero("kids").alias("kids"),
        (zero("leaves") + F.col("kids").isNull().cast("long")).alias("leaves"),
        (zero("saved") + F.col("own")).alias("saved"),
        F.col("pm").alias("am"),
        F.col("pn").alias("an"),
    )
    found = written(first)
    while found.where("an is not null").take(1):
        add = found.where("an is not null").groupBy("am", "an").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        grown = found.join(add.select(F.col("am").alias("m"), F.col("an").alias("n"), "l", "s"), EDGE, "left")
        grown = grown.select(*EDGE, "kids", (F.col("leaves") + zero("l")).alias("leaves"), (F.col("saved") + zero("s")).alias("saved"), "am", "an")
        ahead = found.select(F.col("m").alias("am"), F.col("n").alias("an"), F.col("am").alias("am2"), F.col("an").alias("an2"))
        moved = to_parents(grown.where("an is not null"), ahead, ["am", "an"]).drop("am", "an").withColumnsRenamed({"am2": "am", "an2": "an"})
        found = written(moved.unionByName(grown.where("an is null")))
    return found.select(*EDGE, "leaves", "saved", "kids")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, fa, fb, conv) to the ids of each node in the batch as one text."""
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns[:3]:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        ids = columns[3].tolist()
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c[starts]) for c in columns), pa.array(texts)], [*KEY, "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks of ids to one digest a node; a node's blocks are hashed as they come."""
    now, digest = None, hashlib.sha256()
    keys: list[tuple] = []
    out: list[str] = []

    def batch():
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*keys, strict=True), [pa.int64()] * 3, strict=True)), pa.array(out)], [*KEY, "ends_sha256"])

    for rows in batches:
        for *key, ids in zip(*(rows.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if key == now:
                digest.update(b"," + ids.encode())
                continue
            if now is not None:
                keys.append(tuple(now))
                out.append(digest.hexdigest())
            now, digest = key, hashlib.sha256(ids.encode())
        if len(out) > 10_000:
            yield batch()
            keys.clear()
            out.clear()
    if now is not None:
        keys.append(tuple(now))
        out.append(digest.hexdigest())
        yield batch()


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, fa, fb, ends_sha256) of the nodes at which conversations of ``ends`` (depth, fa, fb, conv) end."""
    order = ["fa", "fb", "depth", "conv"]
    sorted_ = ends.select(*KEY, "conv").repartitionByRange(partitions(ends.sparkSession), *order).sortWithinPartitions(*order)
    packed = sorted_.mapInArrow(_packed, "depth long, fa long, fb long, first long, ids string")
    return packed.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids").mapInArrow(_hashed, "depth long, fa long, fb long, ends_sha256 string")


def trie_nodes(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): (depth, fa, fb, pa, pb, la, m, n, bytes) of each prefix, and (depth, fa, fb, conv) of each end."""
    paths = written(running(rows, convs))
    aggregates = [F.min("conv").alias("m"), F.count(F.lit(1)).alias("n")]
    nodes = paths.groupBy(*KEY).agg(F.min("la").alias("la"), F.min("lb").alias("lb"), *aggregates, F.min("bytes").alias("bytes"))
    nodes = nodes.select(*KEY, F.col("fa").bitwiseXOR(F.col("la")).alias("pa"), F.col("fb").bitwiseXOR(F.col("lb")).alias("pb"), "la", *EDGE, "bytes")
    none = [F.lit(0).cast("long").alias(c) for c in ("fa", "fb", "pa", "pb", "la")]
    root = convs.agg(*aggregates).where("n > 0").select(F.lit(0).cast("long").alias("depth"), *none, *EDGE, F.lit(0).cast("long").alias("bytes"))
    last = convs.select("conv", F.col("length").alias("depth"))
    ends = paths.select("conv", *KEY).join(last.where("depth > 0"), ["conv", "depth"]).select(*KEY, "conv")
    return written(nodes.unionByName(root)), ends.unionByName(last.where("depth = 0").select("depth", none[0], none[1], "conv"))


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` are (conv, depth, a, b, bytes) with depths from 1 without gaps, ``convs`` (conv, length) with one row each.
    A conversation without turns is a member of the root alone; with no conversations there are no nodes.
    """
    nodes, ends = trie_nodes(rows, convs)
    light = max(LEAST_LIGHT, isqrt(convs.count()))
    edges, spans = edges_of(nodes)
    shards = light_shards(edges, light)
    sums = shards.select(*EDGE, "pm", "pn", "own", "label", "shard").groupBy("shard").applyInPandas(_shard_sums, "m long, n long, leaves long, saved long, kids long")
    sums = written(sums)
    sums = sums.unionByName(heavy_sums(edges, sums, light))
    spans = spans.join(edges.select(*EDGE, "top", "bottom", "pm"), EDGE).join(sums, EDGE)
    block = F.floor(F.col("depth") / BLOCK)
    above = Window.partitionBy(*EDGE, "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = nodes.withColumn("block", block).withColumn("above", F.coalesce(F.sum("bytes").over(above), F.lit(0)))
    placed = placed.join(spans, [*EDGE, "block"]).join(end_digests(ends), KEY, "left")
    return placed.select(
        F.col("m").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("top"), F.col("pm")).otherwise(F.col("m")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("depth") == F.col("bottom"), F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * (F.col("before") + F.col("above"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def succinct_tries(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The light tries themselves, a row a shard: ``louds`` (packed bits), ``labels`` of the edges and, of each edge's last node, ``conv_id`` and ``depth``."""
    edges, _ = edges_of(trie_nodes(rows, convs)[0])
    shards = light_shards(edges, max(LEAST_LIGHT, isqrt(convs.count())))
    kept = shards.select(*EDGE, "pm", "pn", "label", "bottom", F.col("shard").cast("long").alias("shard"))
    return kept.groupBy("shard").applyInPandas(_shard_rows, "shard long, n_nodes long, louds binary, labels array<long>, conv_id array<long>, depth array<long>")


def conversation_trie(conversations: DataFrame, family: int = FAMILY, most_shared: int = MOST_SHARED, **columns: str) -> DataFrame:
    """The trie of the rebuilt ``conversations``; see ``rebuilt`` and ``prefix_trie``.

    Rows are taken by turn, nulls first, rows of one turn in the order of a hash of role and text, repeated rows as
    turns of their own. A null role or text is empty; rows with a null id belong to no conversation. Long texts
    and conversations are taken whole. Other columns play no part; an empty table gives no rows.
    """
    return prefix_trie(*rebuilt(written(turns(conversations, **columns)), family, most_shared))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, rebuilt in families of five."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH RECURSIVE steps AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
ranked AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS r FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM ranked), crc),
joined AS (SELECT ids.conv_id, 0 AS own, r, role, text FROM ids JOIN ranked ON ranked.conv_id = base AND r <= h
  UNION ALL SELECT ids.conv_id, 1, r, role, text FROM ids JOIN ranked ON ranked.conv_id = ids.conv_id AND r > h),
placed AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, r) AS depth FROM joined),
turned AS (SELECT conv_id, depth, octet_length(encode(text)) AS bytes, md5(role || chr(0) || text) AS x FROM placed),
paths AS (SELECT conv_id, depth, bytes, string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY depth) AS p FROM turned
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
lengths AS (SELECT conv_id, max(depth) AS len FROM paths GROUP BY conv_id),
nodes AS (SELECT p, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len) AS ends FROM paths JOIN lengths USING (conv_id) GROUP BY p),
kids AS (SELECT p, (SELECT count(*) FROM nodes c WHERE c.depth = nodes.depth + 1 AND starts_with(c.p, nodes.p)) AS kids FROM nodes),
members AS (SELECT nodes.p, paths.p AS top FROM nodes JOIN paths ON paths.conv_id = nodes.conv_id AND paths.depth <= nodes.depth),
sums AS (SELECT top AS p, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * bytes) AS saved FROM members JOIN nodes USING (p) JOIN kids USING (p) GROUP BY top)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n::BIGINT AS n_convs, kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM nodes v JOIN kids USING (p) JOIN sums USING (p) LEFT JOIN nodes u ON v.depth > 0 AND u.p = substr(v.p, 1, (32 * (v.depth - 1))::BIGINT)
"""

QUERIES = {"op11_prefix_trie": (op11_prefix_trie, ORACLE)}
