"""Token counts by the whole-token shortcut.

Offline, each vocabulary string that ends a word is run through the merges; those that come back as exactly
one token are proven whole. A pre-token in that set counts one without any merging; the rest are merged. The
set and the merges are broadcast: their size is fixed by the vocabulary file.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import END, TOKENIZER, Bpe, Kept, loaded, public_path, strided, tokenizer_source
from .common import table, utf8_bytes

LIMIT = 2048


def whole_tokens(model: Bpe) -> set[str]:
    """Pre-tokens proven to encode alone as one token: each candidate string of the vocabulary is merged once."""
    proven = set()
    for string in model.strings.values():
        if not string.endswith(END):
            continue
        try:
            word = bytes(model.byte_of[x] for x in string.removesuffix(END)).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if word and model.pre_tokens(word) == [word] and len(model.merge(word)) == 1:
            proven.add(word)
    return proven


class Counter(Bpe):
    def __init__(self, source: str) -> None:
        super().__init__(source)
        self.whole: set[str] = set()
        self.kept = Kept(self.chunk)

    def chunk(self, chunk: str) -> int:
        return sum(1 if word in self.whole else len(self.merge(word)) for word in self.pre_tokens(chunk))

    def count(self, text: str) -> int:
        kept = self.kept
        return sum(1 if special is not None else sum([kept[c] for c in chunks]) for chunks, special in self.parts(text))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (id_col, ``n_bytes``, ``n_tokens``) for every whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay rows, other columns are not carried, an
    empty table gives no rows.
    """
    source = tokenizer_source(path)
    shared = docs.sparkSession.sparkContext.broadcast((source, frozenset(whole_tokens(Bpe(source)))))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"

    def task(batches):
        text, whole = shared.value
        counter = loaded(Counter, text)
        counter.whole = whole
        for batch in batches:
            for ids, sizes_texts in strided(batch.column(0), list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))):
                yield pa.RecordBatch.from_arrays([ids, pa.array([s for s, _ in sizes_texts], pa.int64()), pa.array([counter.count(t or "") for _, t in sizes_texts], pa.int64())], [id_col, "n_bytes", "n_tokens"])

    return docs.select(id_col, utf8_bytes(F.col(text_col)).alias("n_bytes"), F.col(text_col).cast("string").alias("_text")).mapInArrow(task, schema)


def op5_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents``; over_limit: more than 2048."""
    counted = token_counts(table(spark, sf_dir, "documents"), public_path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op5_whole_token_counts": (op5_whole_token_counts, None)}
