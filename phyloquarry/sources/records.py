"""Text records that end at a mark outside of quotes and comments, however lines and splits cut them.

Spark's text source cuts a file at every end mark, in parallel and across the borders of splits. A mark inside quotes
or a comment is none, so pieces are joined again: a piece takes the reader from one of three states (outside, in
quotes, in a comment) to another, whichever it starts in. Each split tells in which state it ends for each state it
may start in, and how many records end in it; from these few numbers every split knows how it starts, and every piece
its record. The text itself is read twice and shuffled only by record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTSIDE, QUOTED, COMMENT = range(3)
#: What ends each state, and the state that follows.
MARKS = {
    OUTSIDE: (re.compile(r"['\[]"), {"'": QUOTED, "[": COMMENT}),
    QUOTED: (re.compile(r"'"), {"'": OUTSIDE}),
    COMMENT: (re.compile(r"\]"), {"]": OUTSIDE}),
}


def after(text: str, state: int) -> int:
    """The state behind ``text`` if it starts in ``state``. A doubled quote leaves the quotes and enters them again."""
    at = 0
    while True:
        marks, following = MARKS[state]
        found = marks.search(text, at)
        if not found:
            return state
        state, at = following[found[0]], found.end()


def pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(file, block, row, text): the file's text cut at every ``end``, in order of block and row within a file."""
    text = spark.read.option("lineSep", end).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("text"))


def _split_ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each split and state it may start in: the state it ends in and the number of records that end in it."""
    found: dict[tuple, list[list[int]]] = {}
    for frame in frames:
        for file, block, text in zip(frame["file"], frame["block"], frame["text"], strict=True):
            for way in found.setdefault((file, block), [[s, 0] for s in range(3)]):
                way[0] = after(text, way[0])
                way[1] += way[0] == OUTSIDE
    out = [(file, block, start, *way) for (file, block), ways in found.items() for start, way in enumerate(ways)]
    yield pd.DataFrame(out, columns=["file", "block", "start", "state", "n"])


def records(spark: SparkSession, path: str, end: str = ";") -> DataFrame:
    """(record, text): the records of a file or folder, with numbers that grow along it, without their end marks.

    A record ends at an ``end`` outside of '...' and [...]; what stands behind the last one is a record if it is not
    blank. Quotes or comments that never end reach to the end of the file. A folder's files follow each other by name.
    """
    text = pieces(spark, path, end)
    ends = text.select("file", "block", "text").mapInPandas(_split_ends, "file string, block long, start int, state int, n long")
    first: dict[tuple, tuple[int, int]] = {}
    ways: dict[tuple, dict[int, tuple[int, int]]] = {}
    for r in ends.collect():  # three numbers a split
        ways.setdefault((r.file, r.block), {})[r.start] = (r.state, r.n)
    last, state, n = None, OUTSIDE, 0
    for file, block in sorted(ways):
        if file != last:
            last, state, n = file, OUTSIDE, n + (state != OUTSIDE)
        first[file, block] = (state, n)
        state, more = ways[file, block][state]
        n += more

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict[tuple, tuple[int, int]] = {}
        for frame in frames:
            out = []
            for file, block, row, piece in zip(frame["file"], frame["block"], frame["row"], frame["text"], strict=True):
                state, n = now.get((file, block)) or first[file, block]
                out.append((n, block, row, piece))
                state = after(piece, state)
                now[file, block] = (state, n + (state == OUTSIDE))
            yield pd.DataFrame(out, columns=["record", "block", "row", "text"])

    placed = text.mapInPandas(numbered, "record long, block long, row long, text string")
    listed = F.array_sort(F.collect_list(F.struct("block", "row", "text")))
    joined = placed.groupBy("record").agg(F.array_join(F.transform(listed, lambda x: x["text"]), end).alias("text"))
    return joined.where(F.trim(F.translate("text", "\r\n\t", "   ")) != "")
