"""Conversation structure repair: the cheapest edits that give a conversation well-formed turns, by a rank-compressed DP.

Edits are Keep (0), Rerole to user or assistant (3), Delete (4; the only one for blank and repeated rows) and Insert of
an empty user or assistant turn (3); a truncated row that is not deleted adds 3. The role initials must come out as
``(s?(ua)+)?``; of equally cheap edits the audit string of initials that is least in ASCII order is taken.

1. Macro edits: a run of inserts and the edit of the row after it are one code (K, IK, IIK, D, ...). No code is the
   beginning of another, so strings of equally many codes compare as their codes do, place by place.
2. DP: a layer a row, four states (nothing yet, after s, after u, after a). A state keeps its cost, the rank of its
   audit string among the layer's and a pointer to its parent; no string is kept. A state's next string compares as
   (rank of the parent, code). The audit string and the turns are read back from the pointers.
3. Spark: rows are parted by ranges of (conversation, turn, hash), sorted, and read as a stream. A conversation that
   lies within one task is repaired there and then. One that is longer than a chunk or crosses the border of two tasks
   leaves chunks of at most CHUNK_ROWS rows and about CHUNK_BYTES bytes, each of which gives a four by four table of
   costs and ranked codes: the same DP then runs over chunks as if they were rows, and chunks are read back by it.

So no task holds more than a chunk of a long conversation's rows; one task sees a line for each of its chunks, and one
hashes its repaired text as a stream, since a digest is taken in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, written

CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 20

#: Characters that are no content.
SPACE = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that comes next after each state, and the state it leads to.
NEXT_ROLE = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
KINDS = "sua"
FINE, CUT, GONE = range(3)
#: Inserts after the last row with which each state ends well.
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
FAR = 1 << 60


def _moves(kind: str, fault: int) -> list[list[tuple[int, int, str]]]:
    """For each state the macro edits (next state, cost, code) of a row; the least of each next state."""
    found = []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, run = start, ""
        for _ in range(3):  # a third insert would only come round again
            edits = [(state, DELETE, "D")]
            if fault != GONE:
                more = TRUNCATED if fault == CUT else 0
                to = NEXT_ROLE[state][1]
                edits.append((to, REROLE + more, "R"))
                if kind == "s" and state == START:
                    edits.append((SYSTEM, KEEP + more, "K"))
                elif kind and kind == NEXT_ROLE[state][0][0]:
                    edits.append((to, KEEP + more, "K"))
            for end, cost, code in edits:
                option = (cost + INSERT * len(run), run + code)
                best[end] = min(best.get(end, option), option)
            state, run = NEXT_ROLE[state][1], run + "I"
        found.append([(end, cost, code) for end, (cost, code) in best.items()])
    return found


MOVES = {(kind, fault): _moves(kind, fault) for kind in ("", *KINDS) for fault in (FINE, CUT, GONE)}


def _layers(steps, start: int):
    """The DP from ``start`` over ``steps`` (moves of each row or chunk): costs, ranks and the layers of pointers."""
    costs, ranks = [FAR] * 4, [0] * 4
    costs[start] = 0
    layers = []
    for moves in steps:
        best: dict[int, tuple] = {}
        for state in range(4):
            if (cost := costs[state]) < FAR:
                rank = ranks[state]
                for end, more, code in moves[state]:
                    option = (cost + more, rank, code, state)
                    if end not in best or option < best[end]:
                        best[end] = option
        order = {x: i for i, x in enumerate(sorted({b[1:3] for b in best.values()}))}
        costs, ranks = [FAR] * 4, [0] * 4
        for end, (cost, rank, code, _) in best.items():
            costs[end], ranks[end] = cost, order[rank, code]
        layers.append({end: (b[3], b[2]) for end, b in best.items()})
    return costs, ranks, layers


def _back(layers: list, end: int) -> list:
    """(state before, code) of each step that leads to ``end``."""
    path = []
    for layer in reversed(layers):
        state, code = layer[end]
        path.append((state, code))
        end = state
    return path[::-1]


def _closed(costs: list[int], ranks: list[int]) -> tuple[int, int, int]:
    """(cost, state, inserts after the last row) of the best end."""
    cost, _, run, state = min((costs[s] + INSERT * CLOSING[s], ranks[s], CLOSING[s], s) for s in range(4) if costs[s] < FAR)
    return cost, state, run


def _lines(roles: list[str], texts: list[str], start: int, codes: list[str]) -> list[str]:
    """The repaired turns as ``role:text``."""
    state, out = start, []
    for role, text, code in zip(roles, texts, codes, strict=True):
        for edit in code:
            if edit == "D":
                continue
            now, to = NEXT_ROLE[state]
            if edit == "K" and role[:1] == "s":
                to = SYSTEM
            out.append(f"{now}:" if edit == "I" else f"{role if edit == 'K' else now}:{text}")
            state = to
    return out


def _closing_lines(state: int) -> list[str]:
    out = []
    for _ in range(CLOSING[state]):
        role, state = NEXT_ROLE[state]
        out.append(f"{role}:")
    return out


def _faults(roles: list[str], texts: list[str], seen: set[bytes]) -> tuple[list[int], list[int]]:
    """Each row's fault for the DP, and the numbers of blank, duplicate and truncated rows. ``seen`` are marks of earlier rows."""
    faults, counts = [], [0, 0, 0]
    for role, text in zip(roles, texts, strict=True):
        own = mark(role, text)
        content = text.rstrip(SPACE)
        if not content:
            faults.append(GONE)
            counts[0] += 1
        elif own in seen:
            faults.append(GONE)
            counts[1] += 1
        elif content[-1] not in ".!?":
            faults.append(CUT)
            counts[2] += 1
        else:
            faults.append(FINE)
        seen.add(own)
    return faults, counts


def mark(role: str, text: str) -> bytes:
    """128 bits of a row's role and text."""
    head = role.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(len(head).to_bytes(8, "little") + head + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _steps(roles: list[str], faults: list[int]) -> list:
    return [MOVES[role[:1] if role[:1] in KINDS else "", fault] for role, fault in zip(roles, faults, strict=True)]


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired string"


def _whole(roles: list[str], texts: list[str], turns: list[int | None], keep: bool) -> tuple:
    """The columns of RESULT for a conversation that is here as a whole."""
    faults, counts = _faults(roles, texts, set())
    costs, ranks, layers = _layers(_steps(roles, faults), START)
    cost, state, run = _closed(costs, ranks)
    codes = [code for _, code in _back(layers, state)]
    repaired = "\n".join(_lines(roles, texts, START, codes) + _closing_lines(state))
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    digest = hashlib.sha256(repaired.encode("utf-8", "surrogatepass")).hexdigest()
    return gaps, *counts, _illegal([r[:1] for r in roles]), cost, "".join(codes) + "I" * run, digest, repaired if keep else None


def _stream(keep: bool, chunk_rows: int, chunk_bytes: int):
    """Sorted rows (conv, turn, role, text, gone) to results of whole conversations and chunks of the others."""
    names = ["conv", "seq", "turns", "roles", "texts", *(f.split()[0] for f in RESULT.split(", "))]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 6, *[pa.string()] * 3]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        place, n_chunks = context.partitionId() << 32, 0
        out: list[tuple] = []
        held = 0
        conv, kind, first, split, size = None, None, True, False, 0
        roles: list[str] = []
        texts: list[str] = []
        turns: list[int | None] = []

        def batch():
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds], strict=True)], names)

        def close(last: bool):
            """Ends what is held: the rest of a conversation, or (not last) a full chunk of one that goes on."""
            nonlocal n_chunks, held
            if last and not split and not first:
                out.append((conv, None, None, None, None, *_whole(roles, texts, turns, keep)))
                held += 300 + (size if keep else 0)
            else:
                out.append((conv, place + n_chunks, list(turns), list(roles), list(texts), *[None] * 9))
                n_chunks += 1
                held += size + 64 * len(roles)
            roles.clear()
            texts.clear()
            turns.clear()

        empty = True
        for rows in batches:
            kind = rows.schema.field(0).type
            for c, turn, role, text, gone in zip(*(x.to_pylist() for x in rows.columns), strict=True):
                if empty or c != conv:
                    if not empty:
                        close(True)
                        first = False
                    conv, split, size, empty = c, False, 0, False
                elif len(roles) >= chunk_rows or size >= chunk_bytes:
                    split = True
                    close(False)
                    size = 0
                if held > 4 * chunk_bytes:
                    yield batch()
                    out.clear()
                    held = 0
                if not gone:
                    roles.append(role)
                    texts.append(text)
                    turns.append(turn)
                    size += len(text) + len(role)
        if not empty:
            first = True  # the last conversation may go on in the next task
            close(True)
            yield batch()

    return task


def _tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each chunk is to the DP over chunks, and its counts."""
    for frame in frames:
        out = []
        for c in frame.itertuples():
            roles, texts = list(c.roles), list(c.texts)
            faults, counts = _faults(roles, texts, set(map(bytes, c.earlier if c.earlier is not None else ())))
            steps = _steps(roles, faults)
            found = []
            for start in range(4):
                costs, _, layers = _layers(steps, start)
                found += [(start, end, costs[end], "".join(code for _, code in _back(layers, end))) for end in range(4) if costs[end] < FAR]
            order = {x: i for i, x in enumerate(sorted({x[3] for x in found}))}
            known = [int(t) for t in c.turns if t is not None and t == t]
            initials = [r[:1] for r in roles]
            ends = (initials[0], initials[-1]) if initials else (None, None)
            moves = [[s, e, cost, order[code]] for s, e, cost, code in found]
            turns = (known[0], known[-1], len(set(known))) if known else (None, None, 0)
            out.append((c.key, c.seq, [x for m in moves for x in m], *counts, _illegal(initials), *ends, *turns))
        yield pd.DataFrame(out, columns=TABLE_COLUMNS).astype({"least_turn": "Int64", "most_turn": "Int64"})


TABLE = "key string, seq long, moves array<long>, blank long, duplicate long, truncated long, illegal long, head string, tail string, least_turn long, most_turn long, n_turns long"
TABLE_COLUMNS = [f.split()[0] for f in TABLE.split(", ")]


def _chunk_dp(frame: pd.DataFrame) -> pd.DataFrame:
    """The chunks of one conversation: the state each begins and ends with, and on the last the conversation's counts."""
    frame = frame.sort_values("seq")
    steps = []
    for flat in frame["moves"]:
        moves: list[list] = [[] for _ in range(4)]
        for s, e, cost, code in zip(*(flat[i::4] for i in range(4)), strict=True):
            moves[s].append((e, int(cost), int(code)))
        steps.append(moves)
    costs, ranks, layers = _layers(steps, START)
    cost, state, _ = _closed(costs, ranks)
    begins = [s for s, _ in _back(layers, state)]
    gaps, most, least = 0, None, None
    for a, b, n in zip(frame["least_turn"], frame["most_turn"], frame["n_turns"], strict=True):
        if n:
            gaps += n - (most is not None and a == most)
            least, most = a if least is None else least, b
    illegal, tail = int(frame["illegal"].sum()), None
    for a, b in zip(frame["head"], frame["tail"], strict=True):
        if a is not None and a == a:
            illegal += tail is not None and _illegal([tail, a])
            tail = b
    n = len(frame)
    return pd.DataFrame(
        {
            "key": frame["key"], "seq": frame["seq"], "begin": begins, "end": [*begins[1:], state], "last": [False] * (n - 1) + [True],
            "gaps": 0 if least is None else int(most - least + 1 - gaps), "blank": int(frame["blank"].sum()), "duplicate": int(frame["duplicate"].sum()),
            "truncated": int(frame["truncated"].sum()), "illegal": illegal, "cost": cost,
        }
    )


CHOSEN = "key string, seq long, begin int, end int, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each chunk's part of the audit string and of the repaired turns."""
    for frame in frames:
        out = []
        for c in frame.itertuples():
            roles, texts = list(c.roles), list(c.texts)
            faults, _ = _faults(roles, texts, set(map(bytes, c.earlier if c.earlier is not None else ())))
            _, _, layers = _layers(_steps(roles, faults), c.begin)
            codes = [code for _, code in _back(layers, c.end)]
            lines = _lines(roles, texts, c.begin, codes)
            if c.last:
                lines += _closing_lines(c.end)
                codes.append("I" * CLOSING[c.end])
            out.append((c.key, c.seq, "".join(codes), "\n".join(lines) if lines else None, c.last))
        yield pd.DataFrame(out, columns=["key", "seq", "audit", "lines", "last"])


def _joined(keep: bool):
    """Pieces in order to a row for each conversation; the text is hashed as it comes."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        audit: list[str] = []
        held: list[str] = []
        digest, begun = hashlib.sha256(), False
        for frame in frames:
            out = []
            for p in frame.itertuples():
                audit.append(p.audit)
                if p.lines is not None:
                    digest.update((("\n" if begun else "") + p.lines).encode("utf-8", "surrogatepass"))
                    begun = True
                    if keep:
                        held.append(p.lines)
                if p.last:
                    out.append((p.key, "".join(audit), digest.hexdigest(), "\n".join(held) if keep else None))
                    audit, held, digest, begun = [], [], hashlib.sha256(), False
            yield pd.DataFrame(out, columns=["key", "audit", "repaired_sha256", "repaired"])

    return task


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone=None, texts: bool = True, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per conversation: id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``, ``repaired``.

    ``repaired`` holds the turns as ``role:text`` lines (null unless ``texts``). Rows are taken by turn, nulls first;
    rows of one turn in the order of a hash of role and text, so that copies stand together. Null roles and texts
    count as empty. Rows for which ``gone`` holds only name their conversation: one without others gets zeros, an
    empty audit and the digest of nothing. A role that begins with none of s, u and a (an empty one among them) is never
    kept. Rows with a null id are one conversation with that id. Long texts and conversations are taken whole;
    an empty table gives no rows, other columns play no part.
    """
    spark = rows.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    own = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"),
        F.xxhash64(role, text).alias("tie"),
        F.monotonically_increasing_id().alias("salt"),
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "tie"]
    own = own.repartitionByRange(partitions(spark), *order, "salt").sortWithinPartitions(*order, "salt").drop("salt", "tie")
    kind = rows.schema[conv_col].dataType.simpleString()
    fields = f"conv {kind}, seq long, turns array<long>, roles array<string>, texts array<string>, {RESULT}"
    found = written(own.mapInArrow(_stream(texts, chunk_rows, chunk_bytes), fields))
    names = [f.split()[0] for f in RESULT.split(", ")]
    whole = found.where("seq is null").select("conv", *names)
    key = F.when(F.col("conv").isNull(), F.lit("null")).otherwise(F.concat(F.lit("id "), F.col("conv").cast("string")))
    chunks = found.where("seq is not null").select(key.alias("key"), "conv", "seq", "turns", "roles", "texts")
    part = chunks.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    marks = F.array_distinct(F.transform(F.arrays_zip("roles", "texts"), lambda r: F.md5(F.concat_ws(":", F.length(r["roles"]).cast("string"), r["roles"], r["texts"]))))
    pairs = written(chunks.join(part, "key", "left_semi").select("key", "seq", F.explode(marks).alias("m")))
    first = pairs.groupBy("key", "m").agg(F.min("seq").alias("first"))
    again = pairs.join(first, ["key", "m"]).where("seq > first").groupBy("key", "seq").agg(F.collect_set("m").alias("again"))
    joined = chunks.join(again, ["key", "seq"], "left").withColumn("pairs", F.arrays_zip("roles", "texts"))
    told = F.filter("pairs", lambda r: F.array_contains("again", F.md5(F.concat_ws(":", F.length(r["roles"]).cast("string"), r["roles"], r["texts"]))))
    chunks = written(joined.withColumn("earlier", F.when(F.col("again").isNotNull(), told)).drop("pairs", "again"))
    tables = chunks.select("key", "seq", "turns", "roles", "texts", "earlier").mapInPandas(_with_marks(_tables), TABLE)
    chosen = written(tables.groupBy("key").applyInPandas(_chunk_dp, CHOSEN))
    ready = chunks.join(chosen.select("key", "seq", "begin", "end", "last"), ["key", "seq"])
    pieces = ready.select("key", "seq", "roles", "texts", "earlier", "begin", "end", "last").mapInPandas(_with_marks(_pieces), "key string, seq long, audit string, lines string, last boolean")
    text_of = pieces.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(_joined(texts), "key string, audit string, repaired_sha256 string, repaired string")
    counts = chosen.where("last").drop("seq", "begin", "end", "last")
    ids = chunks.groupBy("key").agg(F.first("conv").alias("conv"))
    long = text_of.join(counts, "key").join(ids, "key").select("conv", *names)
    return whole.unionByName(long).withColumnRenamed("conv", conv_col)


def _with_marks(task):
    """``task`` with the rows seen in earlier chunks as marks."""

    def run(frames):
        yield from task(f.assign(earlier=[None if x is None else [mark(r["roles"], r["texts"]) for r in x] for x in f["earlier"]]) for f in frames)

    return run


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with the faults that its hash gives each row; ``gone`` marks the dropped rows."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(blank("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(fault == 3, F.lit(2)).otherwise(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault == 0).alias("gone"), copies.alias("copy"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, damaged and repaired."""
    rows = damaged(table(spark, sf_dir, "conversations"))
    return repaired(rows, gone=F.col("gone"), texts=False).drop("repaired")


ORACLE = r"""
WITH RECURSIVE steps AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 20 AS f FROM conversations, crc),
bad AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE f <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM bad),
faulty AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again > 1 THEN 2
    WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM numbered),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) AS n FROM faulty GROUP BY conv_id),
pairs AS (SELECT conv_id, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS p FROM faulty),
illegal AS (SELECT conv_id, count(*) FILTER (p NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
inserts AS (SELECT * FROM (VALUES ('0', 0, '0', '', ''), ('0', 1, 'u', 'I', 'user:'), ('0', 2, 'a', 'II', 'user:' || chr(10) || 'assistant:'),
    ('s', 0, 's', '', ''), ('s', 1, 'u', 'I', 'user:'), ('s', 2, 'a', 'II', 'user:' || chr(10) || 'assistant:'),
    ('u', 0, 'u', '', ''), ('u', 1, 'a', 'I', 'assistant:'), ('u', 2, 'u', 'II', 'assistant:' || chr(10) || 'user:'),
    ('a', 0, 'a', '', ''), ('a', 1, 'u', 'I', 'user:'), ('a', 2, 'a', 'II', 'user:' || chr(10) || 'assistant:')) v(a, k, b, code, said)),
edits AS (SELECT a, k, b, code, said, e, c FROM inserts, (VALUES ('K', 0), ('R', 3), ('D', 4)) v(e, c)),
dp AS (SELECT conv_id, 0::BIGINT AS n, '0' AS state, 0::BIGINT AS cost, '' AS audit, '' AS said FROM counts
  UNION ALL
  SELECT conv_id, n, state, cost, audit, said FROM (
    SELECT dp.conv_id, f.n, CASE WHEN e = 'D' THEN b WHEN e = 'K' THEN i WHEN b = 'u' THEN 'a' ELSE 'u' END AS state,
      cost + 3 * k + c + CASE WHEN e <> 'D' AND fault = 3 THEN 3 ELSE 0 END AS cost, audit || code || e AS audit,
      dp.said || CASE WHEN k > 0 THEN chr(10) || edits.said ELSE '' END || CASE WHEN e = 'D' THEN '' ELSE chr(10) || CASE WHEN e = 'K' THEN role WHEN b = 'u' THEN 'assistant' ELSE 'user' END || ':' || text END AS said
    FROM dp JOIN faulty f ON f.conv_id = dp.conv_id AND f.n = dp.n + 1 JOIN edits ON edits.a = dp.state
    WHERE e = 'D' OR (fault NOT IN (1, 2) AND (e = 'R' OR (b = '0' AND i IN ('s', 'u')) OR (b = 's' AND i = 'u') OR (b = 'u' AND i = 'a') OR (b = 'a' AND i = 'u')))) x
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
ended AS (SELECT conv_id, dp.cost + 3 * k AS cost, audit || code AS audit, dp.said || CASE WHEN k > 0 THEN chr(10) || inserts.said ELSE '' END AS said
  FROM dp JOIN counts USING (conv_id, n) JOIN inserts ON a = state WHERE (a IN ('0', 'a') AND k = 0) OR (a = 's' AND k = 2) OR (a = 'u' AND k = 1)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY dp.cost + 3 * k, audit || code) = 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(substr(coalesce(said, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts USING (conv_id) LEFT JOIN illegal USING (conv_id) LEFT JOIN ended USING (conv_id)
"""

QUERIES = {"op13_conversation_repair": (op13_conversation_repair, ORACLE)}
