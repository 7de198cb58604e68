"""The prefix trie against a plain one, with every size of block and of light subtree; LOUDS on its own."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from phyloquarry.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string"


def plain(conversations):
    """All nodes from the lists of (role, text) of each conversation, in order."""
    rebuilt = {}
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        rebuilt[c] = conversations.get(base, [])[:h] + own[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, who in members.items():
        own = (len(who) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not kids[p]
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(rebuilt[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(who), len(p), parent, len(who), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def drawn(seed, n=160):
    draw = random.Random(seed)
    rows = []
    for c in range(-7, n):
        kind = draw.randrange(6)
        for t in range(draw.choice([1, 2, 4, 7, 12, 30]) if kind else 6):
            text = f"all {t}" if kind in (0, 1) and t < 5 else draw.choice(["a", "é b", "", None, f"own {c}"]) if t > 3 else draw.choice(["x", "y"])
            rows.append((c, t if t else None, draw.choice(["user", None]) if kind == 5 else "user", text))
    return rows


def lists(rows):
    found = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        found[c].append((role or "", text or ""))
    return found


@pytest.mark.parametrize(("block", "light"), [(4096, 256), (4, 1), (7, 12)])
def test_nodes(spark, monkeypatch, block, light):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "LEAST_LIGHT", light)
    monkeypatch.setattr(prefix_trie, "isqrt", lambda n: 0)
    rows = drawn(3)
    table = spark.createDataFrame([*rows, (None, 1, "user", "lost")], ROWS).withColumn("m", F.lit("mine")).withColumn("conv", F.lit(0)).withColumn("depth", F.lit(1))
    found = prefix_trie.conversation_trie(table.repartition(3))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(lists(rows))


def test_repeated_rows_ties_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 64)
    rows = [(c, t, "user", f"turn {t}" if c < 8 or t < 290 else f"own {c}") for c in range(10) for t in range(300)]
    rows += [(20, 0, "user", "same")] * 5 + [(21, 0, "user", "same")] * 5 + [(25, 0, "user", "x" * 100_000)]
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, ROWS))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(lists(rows))


def test_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], ROWS)).count() == 0


def test_succinct_tries_hold_the_light_subtrees(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_LIGHT", 12)
    rows = drawn(5)
    parts = prefix_trie.rebuilt(prefix_trie.written(prefix_trie.turns(spark.createDataFrame(rows, ROWS))))
    tries = prefix_trie.succinct_tries(*parts).collect()
    found = {(r.conv_id, r.depth): r for r in prefix_trie.prefix_trie(*parts).collect()}
    for t in tries:
        bits = np.unpackbits(np.frombuffer(t.louds, np.uint8))[: 2 * t.n_nodes - 1]
        assert bits.sum() == t.n_nodes - 1 == len(t.labels)
        degrees = np.diff(np.concatenate([[-1], np.flatnonzero(bits == 0)])) - 1
        assert [found[k].n_children for k in zip(t.conv_id, t.depth, strict=True)] == degrees[1:].tolist()
    assert len({k for t in tries for k in zip(t.conv_id, t.depth, strict=True)}) == sum(t.n_nodes - 1 for t in tries)


def test_louds():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 400):
        parent = np.array([draw.integers(-1, i) if i else -1 for i in range(n)], np.int64)
        trie = prefix_trie.Louds(parent, draw.permutation(n).astype(np.int64))
        number = {-1: 0} | {int(g): i + 1 for i, g in enumerate(trie.order)}
        assert trie.parents().tolist() == [number[int(parent[g])] for g in trie.order]
        assert trie.degrees().tolist() == [int((parent == g).sum()) for g in [-1, *trie.order]]
        own = draw.integers(0, 9, n + 1)
        total = own.copy()
        for i in range(n, 0, -1):
            total[trie.parents()[i - 1]] += total[i]
        assert trie.rollup(own).tolist() == total.tolist()
