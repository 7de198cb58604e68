"""Language-model scores by context-tree weighting over bytes.

A text is its tokens: words with A-Z lowered, each written as its bytes and a space, then one end symbol (0xFF,
which UTF-8 never uses). Each byte is decomposed into eight binary choices, and each choice is predicted in
contexts of 0 to DEPTH preceding bytes of the text, those of previous words included; before a text there are
spaces. Every context holds a Krichevsky-Trofimov estimate; the estimates of all depths are mixed by the weights
of the context tree, P = (own + product of the children) / 2.

Counts of (context, byte) come from the running text (sorted and summed in each task, then by a shuffle), and the
tree is evaluated from the deepest contexts up, in groups of about GROUP pairs that hold all pairs with the same
last BASE (3) context bytes. The depths above have at most 65,536 contexts of 255 nodes (200 MB; a few MB for text of any amount) and are finished on the
driver. Every text is then scored byte by byte: the BROADCAST_GRAMS most frequent (context, byte) pairs are looked
up in a broadcast table of that size, all others by a join; texts hold few of those. For the unigram base words are
counted as well, and looked up in the same two ways.
"""

from __future__ import annotations

from collections import Counter
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, written

DEPTH = 5
END = b"\xff"
#: Context bytes that are never parted into two groups of the tree, and the pairs a group is meant to have.
BASE, GROUP = 3, 50_000
#: Words and (context, byte) pairs broadcast at most; words a task counts before it hands them on.
FREQUENT, BROADCAST_GRAMS, HELD = 200_000, 2_000_000, 400_000
#: Bytes turned into grams at once; (context, byte) pairs a task gathers before it sums them; texts it holds as objects.
CHUNK, GATHERED, TEXTS = 1 << 19, 1_000_000, 500

HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0: Stirling's series at x + 8."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1.0)


def packed(stream: bytes) -> np.ndarray:
    """Each byte of ``stream`` after the first DEPTH with the DEPTH bytes before it."""
    raw = np.frombuffer(stream, np.uint8)
    grams = raw[: len(raw) - DEPTH].astype(np.int64)
    for k in range(1, DEPTH + 1):
        grams <<= 8
        grams |= raw[k : len(raw) - DEPTH + k]
    return grams


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, word): the packed DEPTH context bytes and symbol of each step of one text, and the word it belongs to."""
    steps = [len(w) + (w != END) for w in words]
    stream = b" " * DEPTH + b"".join([w if w == END else w + b" " for w in words])
    return packed(stream), np.repeat(np.arange(len(words)), steps)


def running_grams(texts: list[bytes | None]):
    """(grams, text) of a run of texts in pieces of about CHUNK bytes; a long text goes on in the next piece."""
    pad = b" " * DEPTH
    held: list[bytes] = []
    owners: list[tuple[int, int, int]] = []  # text, its steps, steps to skip: those from one text to the next
    size = 0

    def piece():
        text, steps, skip = np.array(owners, np.int64).T
        use = np.repeat(np.tile([False, True], len(text)), np.stack([skip, steps], 1).ravel())[DEPTH:]
        return packed(b"".join(held))[use], np.repeat(text, steps)

    for k, text in enumerate(texts):
        stream = pad + b" ".join(tokens(text or b""))
        for i in range(DEPTH, len(stream), CHUNK):
            part = stream[i - DEPTH : i + CHUNK]
            held.append(part)
            owners.append((k, len(part) - DEPTH, DEPTH))
            size += len(part)
            if size >= CHUNK:
                yield piece()
                held, owners, size = [], [], 0
    if held:
        yield piece()


def slices(batches):
    """Record batches of TEXTS rows at most."""
    for batch in batches:
        for i in range(0, batch.num_rows, TEXTS):
            yield batch.slice(i, TEXTS)


def choices(grams: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The (context of that depth, node) key and the bit of each of the 8 choices of each gram, as 8 rows."""
    context = grams >> 8 & ((1 << 8 * depth) - 1)
    symbol = grams & 255
    nodes = np.array([1 << j | symbol >> (8 - j) for j in range(8)])
    bits = np.array([symbol >> (7 - j) & 1 for j in range(8)])
    return context[None] << 8 | nodes, bits


def evaluate(grams: np.ndarray, counts: np.ndarray, low: int) -> tuple[pd.DataFrame, np.ndarray]:
    """The tree below depth ``low`` for grams that share the last ``low`` context bytes.

    Returns the nodes at that depth (key, a, b, log of the weighted probability) and, for each gram and choice, the
    mixed probability of the bit seen from that depth (8 x grams).
    """
    seen = counts > 0
    levels, children = {}, None
    for depth in range(DEPTH, low - 1, -1):
        key, bit = choices(grams[seen], depth)
        keys, inverse = np.unique(key, return_inverse=True)
        weight = np.broadcast_to(counts[seen].astype(float), key.shape)
        ones = np.bincount(inverse.ravel(), (weight * bit).ravel(), len(keys))
        zeros = np.bincount(inverse.ravel(), weight.ravel(), len(keys)) - ones
        own = log_kt(zeros, ones)
        if children is None:
            mixed = own
        else:
            up = (children[0] >> 8 & ((1 << 8 * depth) - 1)) << 8 | children[0] & 255
            product = np.bincount(np.searchsorted(keys, up), children[1], len(keys))
            mixed = HALF + np.logaddexp(own, product)
        levels[depth] = keys, zeros, ones, own, mixed
        children = keys, mixed
    p = np.full((8, len(grams)), 0.5)
    for depth in range(DEPTH, low - 1, -1):
        keys, zeros, ones, own, mixed = levels[depth]
        key, bit = choices(grams, depth)
        if not len(keys):
            continue
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        known = keys[at] == key
        kt = (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
        leaf = np.ones(len(keys)) if depth == DEPTH else np.exp(HALF + own - mixed)
        p = np.where(known, leaf[at] * kt + (1 - leaf[at]) * p, 0.5)
    keys, zeros, ones, _, mixed = levels[low]
    return pd.DataFrame({"key": keys, "zeros": zeros, "ones": ones, "mixed": mixed}), p


def subtree(frame: pd.DataFrame) -> pd.DataFrame:
    """``evaluate`` for a group of whole subtrees: a row for each gram (with its count) and one for each node."""
    n = frame["n"].to_numpy(np.int64)
    nodes, p = evaluate(frame["gram"].to_numpy(np.int64), n, BASE)
    grams = pd.DataFrame({"gram": frame["gram"].to_numpy(np.int64), "n": n, "p": [x.tobytes() for x in np.ascontiguousarray(p.T)]})
    out = pd.concat([grams, nodes], ignore_index=True)[["gram", "n", "p", "key", "zeros", "ones", "mixed"]]
    return out.astype({"gram": "Int64", "n": "Int64", "key": "Int64"})


class Top:
    """Depths 0 to 2 from the sums over their children: each node's zero probability and its weight as a leaf."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, product: np.ndarray) -> None:
        self.levels = []
        for depth in (2, 1, 0):
            key, group = np.unique(self.cut(key, depth), return_inverse=True)
            zeros, ones, product = (np.bincount(group, x, len(key)) for x in (zeros, ones, product))
            own = log_kt(zeros, ones)
            mixed = HALF + np.logaddexp(own, product)
            self.levels.append((depth, key, (zeros + 0.5) / (zeros + ones + 1), np.exp(HALF + own - mixed)))
            product = mixed

    @staticmethod
    def cut(key: np.ndarray, depth: int) -> np.ndarray:
        """The key (context, node) with the context's last ``depth`` bytes."""
        return (key >> 8 & ((1 << 8 * depth) - 1)) << 8 | key & 255

    def log10(self, grams: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol; ``p`` is the mixture from depth 3 on."""
        for depth, keys, zero, leaf in self.levels:
            key, bit = choices(grams, depth)
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = keys[at] == key
            kt = np.where(bit == 1, 1 - zero[at], zero[at])
            p = np.where(known, leaf[at] * kt + (1 - leaf[at]) * p, 0.5)
        return np.log10(p).sum(0)


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def word_counts(docs: DataFrame, text_col: str, train: Column) -> DataFrame:
    """(word, n): every distinct token of all texts with its count in the training texts."""

    def task(batches):
        held: dict[bytes, int] = Counter()
        for batch in batches:
            for text, trains in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if trains:
                    held.update(tokens(text or b""))
                else:
                    for word in set(tokens(text or b"")):
                        held.setdefault(word, 0)
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    each = docs.select(F.col(text_col).cast("string").cast("binary"), train).mapInArrow(task, "word binary, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def gram_counts(docs: DataFrame, text_col: str, train: Column) -> DataFrame:
    """(gram, n): every distinct (context, byte) of all texts with its count in the training texts."""

    def summed(held: list) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    def rows(keys, n):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["gram", "n"])

    def task(batches):
        held, size = [], 0
        for batch in slices(batches):
            trains = np.asarray(batch.column(1).to_pylist(), np.int64)
            for grams, text in running_grams(batch.column(0).to_pylist()):
                keys, n = np.unique(grams << 1 | trains[text], return_counts=True)
                held.append((keys >> 1, n * (keys & 1)))
                size += len(keys)
                if size > GATHERED:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > GATHERED // 2:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*summed(held))

    each = docs.select(F.col(text_col).cast("string").cast("binary"), train).mapInArrow(task, "gram bigint, n bigint")
    return each.groupBy("gram").agg(F.sum("n").alias("n"))


def gram_scores(grams: DataFrame) -> DataFrame:
    """(gram, n, bits10): log10 probability of each (context, byte) of ``grams`` (gram, n)."""
    grams = written(grams)
    groups = max(ceil(grams.count() / GROUP), partitions(grams.sparkSession))
    group = F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * BASE) - 1))), F.lit(groups))
    tree = written(grams.groupBy(group.alias("group")).applyInPandas(lambda frame: subtree(frame), "gram bigint, n bigint, p binary, key bigint, zeros double, ones double, mixed double"))
    second = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)) * 256 + F.col("key").bitwiseAND(F.lit(255))
    upper = tree.where("key is not null").groupBy(second.alias("key")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "mixed")]).toArrow()  # 65,536 contexts at most
    top = Top(np.asarray(upper["key"], np.int64), *(np.asarray(upper[c], np.float64) for c in ("zeros", "ones", "mixed")))
    shared = grams.sparkSession.sparkContext.broadcast(top)

    def finish(batches):
        for batch in batches:
            keys = np.asarray(batch.column(0), np.int64)
            p = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(-1, 8).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.log10(keys, p))], ["gram", "n", "bits10"])

    return written(tree.where("gram is not null").select("gram", "n", "p").mapInArrow(finish, "gram bigint, n bigint, bits10 double"))


def frequent_grams(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``scores`` parted by count: the most frequent, BROADCAST_GRAMS at most, and the rest."""
    level = F.floor(F.log2(F.col("n") + 1) * 8)
    counts = scores.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()  # 8 rows a power of two
    least, held = 1 << 20, 0
    for r in counts:
        held += r.n
        if held > BROADCAST_GRAMS:
            break
        least = r.level
    return scores.where(level >= least), scores.where(level < least)


def context_tree_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``) for each row.

    ``train`` says which rows the model learns from. A null text is an empty one: the end token alone. Long texts
    are scored whole. With no training rows all estimates stay at their priors. Repeated rows stay rows; empty
    tables give none; other columns are not carried.
    """
    spark = docs.sparkSession
    trains = F.coalesce(train, F.lit(False))
    words = written(word_counts(docs, text_col, trains))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    base = F.log10((F.col("n") + 1) / F.lit(float(total.n + total.v + 1)))
    known = words.select("word", (F.col("n") > 0).alias("known"), base.alias("base"), "n")
    top = known.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "known", "base").toArrow()
    shared = spark.sparkContext.broadcast({w: (k, b) for w, k, b in zip(*(top[c].to_pylist() for c in ("word", "known", "base")), strict=True)})
    common, seldom = frequent_grams(gram_scores(gram_counts(docs, text_col, trains)))
    rows = common.select("gram", "bits10").toArrow()
    keys, values = np.asarray(rows["gram"], np.int64), np.asarray(rows["bits10"], np.float64)
    order = np.argsort(keys)
    grams_of = spark.sparkContext.broadcast((keys[order], values[order]))

    def text_scores(texts: list) -> tuple[np.ndarray, list]:
        """The score of each text by the broadcast grams, and (text, gram, count) of the others."""
        keys, values = grams_of.value
        out, rest = np.zeros(len(texts)), []
        for grams, text in running_grams(texts):
            distinct, inverse = np.unique(grams, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
            known = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
            found = np.where(known, values[at], 0.0) if len(keys) else np.zeros(len(distinct))
            out += np.bincount(text, found[inverse], len(texts))
            missed = np.flatnonzero(~known[inverse])
            if len(missed):
                pairs, n = np.unique(np.stack([text[missed], grams[missed]]), axis=1, return_counts=True)
                rest.append((*pairs, n))
        return out, rest

    names = ["row", "word", "gram", "n", "known", "size", "base", "score"]

    def part(**columns):
        n = len(columns["row"])
        kinds = dict(zip(names, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names)

    def task(batches):
        frequent = shared.value
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            scores, rest = text_scores(texts)
            for text, gram, n in rest:
                yield part(row=np.asarray(ids, np.int64)[text], gram=gram, n=n)
            whole: list[tuple] = []
            rare: list[tuple] = []
            for row, text, score in zip(ids, texts, scores.tolist(), strict=True):
                found = tokens(text or b"")
                known, base = 0, 0.0
                for word, n in Counter(found).items():
                    if hit := frequent.get(word):
                        known += n * hit[0]
                        base += n * hit[1]
                    else:
                        rare.append((row, word, n))
                whole.append((row, len(found), known, sum(map(len, found)) + len(found) - 1, base, score))
            if rare:
                yield part(**dict(zip(("row", "word", "n"), zip(*rare, strict=True), strict=True)))
            yield part(**dict(zip(("row", "n", "known", "size", "base", "score"), zip(*whole, strict=True), strict=True)))

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").cast("binary").alias("text"), F.col(id_col).alias("id"))
    parts = written(numbered.mapInArrow(with_id(task), f"row bigint, word binary, gram bigint, n bigint, known bigint, size bigint, base double, score double, id {docs.schema[id_col].dataType.simpleString()}"))
    rare = parts.where("word is not null").select("row", "word", "n").join(known.select("word", "known", F.col("base").alias("b")), "word")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("known").cast("long")).alias("k"), F.sum(F.col("n") * F.col("b")).alias("b"))
    missed = parts.where("gram is not null").select("row", "gram", F.col("n").alias("times")).join(seldom.select("gram", "bits10"), "gram")
    missed = missed.groupBy("row").agg(F.sum(F.col("times") * F.col("bits10")).alias("s"))
    whole = parts.where("size is not null").join(rare, "row", "left").join(missed, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return whole.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_tokens"),
        add("known", "k").alias("n_known"),
        F.lit(total.n).cast("long").alias("train_tokens"),
        add("base", "b").alias("base_score"),
        add("score", "s").alias("score"),
        (-add("score", "s") / F.lit(float(np.log10(2))) / F.greatest("size", F.lit(1))).alias("bits_per_byte"),
    )


def with_id(task):
    """``task`` with the id (third input column) of each text appended to its rows."""

    def carried(batches):
        for batch in slices(batches):
            ids = dict(zip(batch.column(0).to_pylist(), range(batch.num_rows), strict=True))
            for out in task([batch]):
                at = pa.array([ids[r] for r in out.column(0).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2).take(at)], [*out.schema.names, "id"])

    return carried


def op4_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learned from those whose crc32(doc_id) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held = lambda: F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    found = context_tree_scores(docs, ~held())
    return found.select("doc_id", held().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


QUERIES = {"op4_context_tree_weighting": (op4_context_tree_weighting, None)}
