"""Conversation repair against all strings kept in full, with conversations cut into chunks of every size."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from phyloquarry.llm import conversation_repair as repair

ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "repaired"]


def plain(conv, rows):
    """The same result from a table of (cost, audit string, lines) for each state, rows as (turn, role, text) in order."""
    best, seen, counts, initials = {"": (0, "", ())}, set(), [0, 0, 0], [r[1][:1] for r in rows]

    def put(into, state, option):
        if state not in into or option[:2] < into[state][:2]:
            into[state] = option

    def inserted(options):
        out = {}
        for state, (cost, audit, lines) in options.items():
            for n in range(4):
                put(out, state, (cost + 3 * n, audit + "I" * n, lines))
                role = "assistant" if state == "u" else "user"
                state, lines = role[0], (*lines, f"{role}:")
        return out

    for _, role, text in rows:
        content = text.rstrip(" \t\n\v\f\r")
        blank, again = not content, (role, text) in seen
        cut = not blank and not again and content[-1] not in ".!?"
        counts = [a + b for a, b in zip(counts, (blank, again and not blank, cut), strict=True)]
        seen.add((role, text))
        after = {}
        # all runs of inserts before this row's edit, each kept apart since a later one may be the least
        options = [(state, *v) for state, v in best.items()]
        grown = list(options)
        for _n in range(3):
            options = [("a" if s == "u" else "u", c + 3, a + "I", (*ls, "assistant:" if s == "u" else "user:")) for s, c, a, ls in options]
            grown += options
        for state, cost, audit, lines in grown:
            put(after, state, (cost + 4, audit + "D", lines))
            if not blank and not again:
                to = "assistant" if state == "u" else "user"
                put(after, to[0], (cost + 3 + 3 * cut, audit + "R", (*lines, f"{to}:{text}")))
                if role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[state] and role[:1]:
                    put(after, role[:1], (cost + 3 * cut, audit + "K", (*lines, f"{role}:{text}")))
        best = after
    ends = [(v[0], v[1], v[2]) for s, v in inserted(best).items() if s in ("", "a")]
    cost, audit, lines = min(ends, key=lambda x: x[:2])
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    text = "\n".join(lines)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), text)


def drawn(seed):
    draw = random.Random(seed)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(draw.choice([0, 1, 2, 5, 9, 17])):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, draw.choice([None, turn, turn, turn + conv % 3 if conv else turn]), role, draw.choice(["a.", "b!", "cut", " ", "", None, f"line {turn}?\n", "é。", "x.  "])))
        rows.append((conv, 99, "user", "gone."))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = drawn(4)
    return spark.createDataFrame(rows, ROWS).withColumn("conv", F.lit("mine")).withColumn("seq", F.lit(1)).withColumn("key", F.lit(2)).repartition(3)


@pytest.fixture(scope="module")
def expected(spark, table):
    order = table.where("text is null or text <> 'gone.'").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    found = {}
    for r in order.orderBy("conv_id", F.col("turn").asc_nulls_first(), F.xxhash64("role", "text")).collect():
        found.setdefault(r.conv_id, []).append(tuple(r)[1:])
    ids = {r.conv_id for r in table.select("conv_id").distinct().collect()}
    return sorted((plain(c, found.get(c, [])) for c in ids), key=str)


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_repair_against_full_strings(table, expected, chunk):
    found = repair.repaired(table, gone=F.col("text") == "gone.", chunk_rows=chunk)
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected


def test_one_long_conversation_among_many_tasks(spark):
    rows = [(7, i // 2, "user" if i % 3 else "assistant", f"turn {i % 50}" + "." * (i % 4 > 0)) for i in range(400)] + [(8, 0, "system", "x" * 5000 + ".")]
    table = spark.createDataFrame(rows, ROWS)
    key = [F.col("turn"), F.xxhash64("role", "text")]
    ordered = [tuple(r) for r in table.where("conv_id = 7").orderBy(*key).select("turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r) for r in repair.repaired(table, chunk_rows=32, chunk_bytes=2000).collect()}
    assert found[7] == plain(7, ordered)
    assert found[8] == plain(8, [r[1:] for r in rows[-1:]])


def test_nothing(spark):
    assert repair.repaired(spark.createDataFrame([], ROWS)).count() == 0


def test_damage(spark):
    rows = spark.createDataFrame([(i, j, "assistant", "a.b?") for i in range(60) for j in range(3)] + [(None, None, None, None)], ROWS)
    found = repair.damaged(rows).withColumn("f", F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20).collect()
    want = {0: ("assistant", "a.b?", True), 1: ("assistant", "", False), 2: ("assistant", "ab", False), 4: ("user", "a.b?", False)}
    for r in found:
        if r.conv_id is not None:
            assert (r.role, r.text, r.gone) == want.get(r.f, ("assistant", "a.b?", False))
        else:
            assert (r.role, r.text) == (" ", " ")
    assert sum(r.f == 3 for r in found) == 2 * sum(r.f == 3 for r in found if r.copy == 1) > 0
