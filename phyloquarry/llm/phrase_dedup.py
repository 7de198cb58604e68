"""Removal of recurring passages with sharded Aho-Corasick automata.

A window of WINDOW consecutive words is removed from a document if it also starts in one with a smaller id.

1. Confirm: of every window the phrase of PHRASE words with the least hash is an anchor, so two equal windows always
   share one. Anchors are grouped over all documents; those of two documents or more recur. The smallest document
   that has one is its home.
2. Recurring phrases are dealt into shards by their homes, where their words are read. A document goes to each shard
   that one of its anchors names, once; a shard that more than SHARD_BYTES of documents go to is split into parts,
   with the same phrases in each. A part compiles its phrases into one Aho-Corasick automaton and streams its
   documents through it whole. A window in which the automaton found a phrase, whichever one, is a candidate; no
   hashes of words are looked at here. Candidates are grouped over all documents by the BLAKE2b digest (128 bits) of
   their words, which stands for the words: the smallest document is a window's owner. Only the smallest document of
   a part leaves it.
3. Each document is told the runs of its candidates and the digests of those it owns; the words of all other
   candidates go.

Automata and parts stay of one size however large the corpus. A phrase, or a shard, that a large share of all documents
holds is joined by a broadcast of such phrases or shards, of which there can only be few. Rows without an id are left
out of all this; their words are only joined.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import compress
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import partitions, table, utf8_bytes, written
from .wordhash import U, Words, mix, parts

WINDOW, PHRASE = 50, 12
SHARD_BYTES = 2_000_000
MOST = np.iinfo(np.uint64).max
#: A key of more than one in HOT_SHARES of a shuffle partition's share of the rows is broadcast.
HOT_SHARES = 4


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick(x[i : i + width]) for each i, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``known``, by binary search."""
    if not len(known):
        return np.zeros(len(x), bool)
    known = np.sort(known)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


class Windows:
    """Anchors and windows of a string column, with windows over two rows ruled out."""

    def __init__(self, column: pa.Array, window: int, phrase: int) -> None:
        self.words, self.window, self.phrase = Words(column), window, phrase
        n = len(self.words)
        row = self.words.row
        self.row_of = np.repeat(np.arange(len(row) - 1), np.diff(row))
        self.phrases = self.words.runs(phrase)
        inside = self.row_of[: len(self.phrases)] == self.row_of[phrase - 1 :] if n >= phrase else np.zeros(0, bool)
        self.phrases[~inside] = MOST
        width = window - phrase + 1
        self.width = width
        if n < window:
            self.least, self.valid = np.zeros(0, U), np.zeros(0, bool)
            return
        self.valid = self.row_of[: n - window + 1] == self.row_of[window - 1 :]
        self.least = sliding(self.phrases, width, np.minimum)

    def anchors(self) -> np.ndarray:
        """Which phrases are the least of some window."""
        if not len(self.least):
            return np.zeros(len(self.phrases), bool)
        edge = np.zeros(self.width - 1, U)
        high = sliding(np.concatenate([edge, np.where(self.valid, self.least, U(0)), edge]), self.width, np.maximum)
        return (high == self.phrases) & (high > 0)


class Phrases:
    """One automaton of phrases, which are words joined by one space."""

    def __init__(self, phrases: list[bytes], phrase: int) -> None:
        self.phrase, self.automaton = phrase, ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for text in phrases:
            self.automaton.add_word(f" {text.decode('latin-1')} ")
        if len(self.automaton):
            self.automaton.make_automaton()

    def starts(self, words: Words) -> np.ndarray:
        """The words at which a phrase begins, in whichever row."""
        row, out = words.row.tolist(), [np.zeros(0, np.int64)]
        if not len(self.automaton):
            return out[0]
        for i, (a, b) in enumerate(zip(row[:-1], row[1:], strict=True)):
            if b - a < self.phrase:
                continue
            line = b" ".join(words.of_row(i)).decode("latin-1")
            ends = [e for e, _ in self.automaton.iter(f" {line} ")]
            if ends:
                sizes = words.end[a:b] - words.start[a:b] + 1
                out.append(a + np.searchsorted(np.cumsum(sizes), np.array(ends)) + 1 - self.phrase)
        return np.concatenate(out)


def rows_of_words(words: Words) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(words.row) - 1), np.diff(words.row))


def windows_over(words: Words, starts: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Windows of one row (their first words) that hold a phrase which begins at one of ``starts``."""
    if len(words) < window or not len(starts):
        return np.zeros(0, np.int64)
    flags = np.zeros(len(words) - phrase + 1, bool)
    flags[starts] = True
    row = rows_of_words(words)
    return np.flatnonzero(sliding(flags, window - phrase + 1, np.logical_or) & (row[: len(row) - window + 1] == row[window - 1 :]))


def digests(words: Words, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the digest of the words of each of the windows ``at``, which are in order."""
    row_of, row, starts = rows_of_words(words)[at], words.row, words.start
    out, last, ends = [], -1, []
    for i, r in zip(at.tolist(), row_of.tolist(), strict=True):
        if r != last:
            a, b = row[r], row[r + 1]
            view, last = memoryview(b" ".join(words.of_row(r))), r
            ends = np.concatenate(([0], np.cumsum(words.end[a:b] - starts[a:b] + 1))).tolist()
        k = i - a
        out.append(blake2b(view[ends[k] : ends[k + window] - 1], digest_size=16).digest())
    both = np.frombuffer(b"".join(out) or bytearray(), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def keyed(row: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One 64-bit key for a row and a hash, for use inside a shard."""
    return mix(x ^ mix(row.astype(U) + U(1)))


def of_shares(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts``, one a key, where ``n`` adds up to ``total`` at most over all keys.

    Keys with more than one in HOT_SHARES of a shuffle partition's share are joined by a broadcast: there are fewer
    than HOT_SHARES a partition. The others can't fill a task.
    """
    hot = F.col(n) * (HOT_SHARES * partitions(rows.sparkSession)) > total
    return rows.join(F.broadcast(facts.where(hot)), key).unionByName(rows.join(facts.where(~hot), key))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(id, ``n_words``, ``n_removed``, ``kept``) for each row; ``kept`` joins the words left by one space.

    Windows are judged on the input. A null text has no words. Rows with a null id neither lose words nor make
    others lose them; rows that share an id do not affect each other, whatever their texts. Empty tables give no rows; other columns are not carried.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    arrow_kind, name = to_arrow_type(kind), kind.simpleString()
    size = docs.agg(F.coalesce(F.sum(utf8_bytes(F.col(text_col))), F.lit(0)).alias("n")).first().n
    shards = max(ceil(size / SHARD_BYTES), 4 * partitions(spark))
    shard_of = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    named = rows.where("id is not null")

    def anchors(batches):
        for whole in batches:
            for batch in parts(whole, 1):
                found = Windows(batch.column(1), window, phrase)
                at = np.flatnonzero(found.anchors())
                if len(at):
                    at = at[np.unique(keyed(found.row_of[at], found.phrases[at]), return_index=True)[1]]
                    row = found.row_of[at]
                    inner = pa.array((at - found.words.row[row]).astype(np.int32))
                    sizes = pa.array(np.diff(found.words.offsets)[row])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(found.phrases[at].view(np.int64)), inner, sizes], ["id", "anchor", "at", "size"])

    held = written(named.where("text is not null").mapInArrow(anchors, f"id {name}, anchor bigint, at int, size bigint"))
    homes = held.groupBy("anchor").agg(F.min(F.struct("id", "at")).alias("home"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    homes = written(homes.where("home.id < last").select("anchor", "home.id", "home.at", "n"))
    total = held.count()
    routes = of_shares(held.select("id", "anchor", "size"), homes.select("anchor", shard_of.alias("shard"), "n"), "anchor", "n", total)
    routes = written(routes.groupBy("id", "shard").agg(F.max("size").alias("size")))
    loads = written(routes.groupBy("shard").agg(F.ceil(F.sum("size") / SHARD_BYTES).alias("parts"), F.count(F.lit(1)).alias("n")))
    routes = written(of_shares(routes, loads, "shard", "n", routes.count()).select("id", "shard", F.pmod(F.xxhash64("id", F.lit(1)), "parts").cast("int").alias("part")))
    def texts(batches):
        for whole in batches:
            for batch in parts(whole, 0):
                found = Windows(batch.column(0), window, phrase)
                row, out = found.words.row, set()
                for i, wanted in enumerate(batch.column(1).to_pylist()):
                    for x in wanted:  # rows that share an id may hold other words at this place
                        k = int(row[i]) + x["at"]
                        if k + phrase <= row[i + 1] and found.phrases[k].view(np.int64) == x["anchor"]:
                            out.add((batch.column(2)[i].as_py(), found.words.text(k, phrase)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([t for _, t in out], pa.binary())], ["shard", "phrase"])

    # Texts are shuffled by id once: all three joins below read the same exchange, at every size.
    wanted = homes.groupBy("id").agg(F.collect_list(F.struct("anchor", "at")).alias("wanted"))  # fewer than the document's words
    phrases = named.join(wanted.hint("merge"), "id").select("text", "wanted", shard_of.alias("shard")).mapInArrow(texts, "shard int, phrase binary")
    phrases = phrases.join(loads, "shard").select("shard", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), "phrase")

    def candidates(left: pa.Table, right: pa.Table) -> tuple[Words, np.ndarray]:
        words = Words(left.column("text").combine_chunks())
        return words, windows_over(words, Phrases(right.column("phrase").to_pylist(), phrase).starts(words), window, phrase)

    seen_as = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("id", arrow_kind)])

    def seen(left: pa.Table, right: pa.Table) -> pa.Table:
        """The digest of each candidate with the least of the part's ids that have it."""
        if not left.num_rows or not right.num_rows:
            return seen_as.empty_table()
        words, at = candidates(left, right)
        high, low = digests(words, at, window)
        ids_ = left.column("id").combine_chunks()
        rank = np.asarray(pc.rank(ids_, tiebreaker="dense")).astype(np.int64)
        row = rows_of_words(words)[at]
        order = np.lexsort((rank[row], low, high))
        high, low, row = high[order], low[order], row[order]
        first = np.ones(len(order), bool)
        first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        return pa.Table.from_arrays([pa.array(high[first]), pa.array(low[first]), ids_.take(pa.array(row[first]))], schema=seen_as)

    run_as = pa.schema([("id", arrow_kind), ("tag", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def located(left: pa.Table, right: pa.Table) -> pa.Table:
        """The runs of candidates of each row, by the places of their first and last."""
        if not left.num_rows or not right.num_rows:
            return run_as.empty_table()
        words, at = candidates(left, right)
        if not len(at):
            return run_as.empty_table()
        row = rows_of_words(words)[at]
        breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(row) != 0)) + 1
        first, last = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(at)])) - 1
        inner = (at - words.row[row]).astype(np.int32)
        there = pa.array(row[first])
        return pa.Table.from_arrays([left.column("id").combine_chunks().take(there), left.column("tag").combine_chunks().take(there), pa.array(inner[first]), pa.array(inner[last])], schema=run_as)

    def strip(batches):
        for whole in batches:
            for batch in parts(whole, 1):
                ids_, words = batch.column(0), Words(batch.column(1))
                row = words.row
                gone = np.zeros(len(words) + 1, np.int64)
                spots, protected = [np.zeros(0, np.int64)], []
                for i, (tag, runs, owned) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
                    runs = [np.arange(x["first"], x["last"] + 1) for x in runs or () if x["tag"] == tag]
                    spots.append(row[i] + np.unique(np.concatenate(runs)) if runs else spots[0])
                    protected.append(np.array(owned or [], np.int64))
                high = digests(words, np.concatenate(spots), window)[0]
                for at, owned, mine in zip(spots[1:], protected, np.split(high, np.cumsum([len(x) for x in spots[1:-1]])), strict=True):
                    if len(at):
                        at = at[~among(mine, owned)]
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                kept = []
                removed = np.concatenate(([0], np.cumsum(gone)))
                for i, (a, b) in enumerate(zip(row[:-1], row[1:], strict=True)):
                    stay = words.of_row(i)
                    if removed[b] > removed[a]:
                        stay = compress(stay, (~gone[a:b]).tolist())
                    kept.append(b" ".join(stay).decode())
                yield pa.RecordBatch.from_arrays([ids_, pa.array(np.diff(row).astype(np.int64)), pa.array((removed[row[1:]] - removed[row[:-1]]).astype(np.int64)), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    routed = named.join(routes.hint("merge"), "id").select("id", F.xxhash64("text").alias("tag"), "text", "shard", "part")
    streams = routed.groupBy("shard", "part").cogroup(phrases.groupBy("shard", "part"))
    owners = streams.applyInArrow(seen, f"high bigint, low bigint, id {name}").groupBy("high", "low").agg(F.min("id").alias("id"))
    owned = owners.select("id", F.col("high").alias("owned"))  # inside one document, half a digest tells windows apart
    runs = streams.applyInArrow(located, f"id {name}, tag bigint, first int, last int")
    run = F.when(F.col("tag").isNotNull(), F.struct("tag", "first", "last"))
    marks = runs.unionByName(owned, allowMissingColumns=True).groupBy("id").agg(F.collect_list(run).alias("runs"), F.collect_list("owned").alias("owned"))  # no more than words, in each
    marked = named.join(marks.hint("merge"), "id", "left").select("id", "text", F.xxhash64("text").alias("tag"), "runs", "owned")
    schema = f"id {name}, n_words bigint, n_removed bigint, kept string"
    changed = marked.mapInArrow(strip, schema)

    def joined(batches):
        for batch in batches:
            words = [(x or "").encode().split() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([0] * len(words), pa.int64()), pa.array([b" ".join(w).decode() for w in words], pa.string())], ["id", "n_words", "n_removed", "kept"])

    whole = rows.where("id is null").mapInArrow(joined, schema)
    return changed.unionByName(whole).withColumnRenamed("id", id_col)


def op3_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the words of windows of 50 that start in an earlier document."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS pos, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 49], ' ')) AS k FROM s),
o AS (SELECT k, min(doc_id) AS owner FROM h GROUP BY k HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS p FROM h JOIN o USING (k) WHERE doc_id > owner),
gone AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
r AS (SELECT doc_id, len(w) AS n, coalesce(len(gone), 0) AS c, CASE WHEN gone IS NULL THEN w ELSE
  list_transform(list_filter(list_zip(w, list_transform(range(1, len(w) + 1), lambda i: list_contains(gone, i))), lambda z: NOT z[2]), lambda z: z[1]) END AS kept
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, c::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM r
"""

QUERIES = {"op3_phrase_automata": (op3_phrase_automata, ORACLE)}
