"""Byte-pair encoding and decoding of whole texts with a published vocabulary file.

The vocabulary file is read once on the driver (its path is a parameter) and broadcast: its size is fixed by
the file, a few MB. Tasks encode Arrow batches. Words are merged with a priority queue of merge ranks: of up to SHORT
symbols a list of the ranks, of more a heap over a doubly linked symbol list; entries whose pair has changed since they were
queued are stale and skipped.
Results are kept in a bounded table for each worker, so that a common word is merged once.
"""

from __future__ import annotations

import heapq
import json
import struct
from functools import lru_cache
from unicodedata import is_normalized, normalize

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKENIZER = "word_bpe_49k.json"
END = "</w>"
#: Chunks kept by a worker, at most; longer chunks are not kept.
KEPT_CHUNKS, KEPT_CHARS = 300_000, 64
#: Symbols of a pre-token up to which the least rank is found by a scan, not by a heap; and what stands for no merge.
SHORT, NONE = 32, 1 << 62
#: Texts' characters encoded at a time.
STRIDE = 2_000_000

WHITE = regex.compile(r"[\t-\r \x85\p{Z}]+")
ODD_WHITE = regex.compile("[\x1c-\x1f]")
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PRE_TOKEN_ODD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\p{Z}\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary with its merges: pre-tokens to ids and back."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.base = max(self.strings) + 1
        letters = byte_letters()
        self.first = [vocab[x] for x in letters]
        self.last = [vocab[x + END] for x in letters]
        self.merges = {vocab[a] * self.base + vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.packed = {pair: rank << 32 | new for pair, (rank, new) in self.merges.items()}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.byte_of = {x: b for b, x in enumerate(letters)}

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        raw = word.encode()
        ids = [self.first[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        end = len(ids)
        if end == 1:
            return ids
        return self.merge_short(ids) if end <= SHORT else self.merge_long(ids)

    def merge_short(self, ids: list[int]) -> list[int]:
        """The merges of few symbols: the queue is the list of the pairs' ranks, the first of the least is taken by a scan."""
        packed, base = self.packed, self.base
        queue = [packed.get(a * base + b, NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while queue and (least := min(queue)) != NONE:
            i = queue.index(least)
            del queue[i], ids[i + 1]
            new = ids[i] = least & 0xFFFFFFFF
            if i < len(queue):
                queue[i] = packed.get(new * base + ids[i + 1], NONE)
            if i:
                queue[i - 1] = packed.get(ids[i - 1] * base + new, NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The merges of any number of symbols, by a heap and a linked list."""
        merges, base, end = self.merges, self.base, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = [(found[0] << 40) | i for i in range(end - 1) if (found := merges.get(ids[i] * base + ids[i + 1]))]
        heapq.heapify(queue)
        gone = -1
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFFFF
            j = after[i]
            if ids[i] == gone or j >= end:
                continue
            found = merges.get(ids[i] * base + ids[j])
            if found is None or found[0] != entry >> 40:
                continue
            ids[i], ids[j] = found[1], gone
            k = after[i] = after[j]
            if k < end:
                before[k] = i
                if right := merges.get(ids[i] * base + ids[k]):
                    heapq.heappush(queue, (right[0] << 40) | i)
            h = before[i]
            if h >= 0 and (left := merges.get(ids[h] * base + ids[i])):
                heapq.heappush(queue, (left[0] << 40) | h)
        return [x for x in ids if x != gone]

    def chunks(self, text: str) -> list[str]:
        """Runs without white space of the normalised text; no token spans two of them."""
        if not is_normalized("NFC", text):
            text = normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()
        if ODD_WHITE.search(text):  # str.split() would part words there
            return [x for x in WHITE.split(text) if x]
        return text.split()

    def pre_tokens(self, chunk: str) -> list[str]:
        if chunk.isascii() and chunk.isalpha():
            return [chunk]
        return (PRE_TOKEN_ODD if ODD_WHITE.search(chunk) else PRE_TOKEN).findall(chunk)

    def parts(self, text: str):
        """(chunks, None) for stretches of ordinary text and ((), id) for special strings, in order."""
        at = 0
        if self.split_special and "<" in text:
            for m in self.split_special.finditer(text):
                yield self.chunks(text[at : m.start()]), None
                yield (), self.special[m[0]]
                at = m.end()
        yield self.chunks(text[at:] if at else text), None


class Kept(dict):
    """A table of chunk results that fills itself and is emptied when full."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str):
        found = self.make(chunk)
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= KEPT_CHUNKS:
                self.clear()
            self[chunk] = found
        return found


class Codec(Bpe):
    """Packed ids and decoded text of whole texts."""

    def __init__(self, source: str) -> None:
        super().__init__(source)
        self.kept = Kept(self.chunk)

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        ids = [i for word in self.pre_tokens(chunk) for i in self.merge(word)]
        return pack(ids), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings in order, joined as the file's library joins them when no decoder is given."""
        return " ".join([self.strings[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, str]:
        packed, decoded = [], []
        for chunks, special in self.parts(text):
            if special is None:
                found = [self.kept[c] for c in chunks]
                packed += [x[0] for x in found]
                decoded += [x[1] for x in found if x[1]]
            else:
                packed.append(pack([special]))
                decoded.append(self.strings[special])
        return b"".join(packed), " ".join(decoded)


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(4)
def loaded(kind: type, source: str):
    """One instance for each worker and file."""
    return kind(source)


def tokenizer_source(path: str) -> str:
    """The vocabulary file's text, read by the driver; merges decide all, so other settings stay at default."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def strided(ids: list, texts: list):
    """Slices of a batch of about STRIDE characters of text."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text[-1] or "") if isinstance(text, tuple) else len(text or "")
        if size >= STRIDE:
            yield ids[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield ids[start:], texts[start:]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (id_col, ``token_ids``, ``decoded``): every whole text encoded and decoded again.

    ``token_ids`` is binary, little-endian unsigned 32-bit ids, without begin or end tokens; special strings in
    a text become their own ids. A null text counts as empty: no ids, empty ``decoded``. Repeated rows stay
    rows. Other columns are not carried. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_source(path))
    kind = docs.schema[id_col]
    schema = f"`{id_col}` {kind.dataType.simpleString()}, token_ids binary, decoded string"

    def task(batches):
        codec = loaded(Codec, shared.value)
        for batch in batches:
            for ids, texts in strided(batch.column(0), batch.column(1).to_pylist()):
                pairs = [codec.encode(t or "") for t in texts]
                yield pa.RecordBatch.from_arrays([ids, pa.array([x[0] for x in pairs], pa.binary()), pa.array([x[1] for x in pairs], pa.string())], [id_col, "token_ids", "decoded"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(task, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of ``bpe_encode``'s rows."""
    return encoded.select(
        id_col,
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def public_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded with the word-level vocabulary, as digests."""
    return digests(bpe_encode(table(spark, sf_dir, "documents"), public_path(TOKENIZER)))


QUERIES = {"op7_bpe_codec": (op7_bpe_codec, None)}
