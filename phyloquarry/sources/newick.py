"""Trees in Newick and Nexus text, to and from node tables. Trees are records that end at a semicolon, on any number of lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import records

TOKEN = re.compile(r"\s*(\[&[^\]]*\]|\[[^\]]*\]|'(?:[^']|'')*'|[(),:;]|[^\s(),:;\[\]]+)")
PAIR = re.compile(r"([^,={}]+)=(\{[^}]*\}|[^,]*)")
SCHEMA = "tree bigint, node int, parent int, label string, length double, height double, meta map<string,string>"


def parse(text: str) -> list[dict]:
    """Nodes of one tree, parents before children; ``height`` is the distance above the lowest tip."""
    nodes: list[dict] = [{"node": 0, "parent": None, "label": None, "length": 0.0, "meta": {}}]
    at = 0
    tokens = TOKEN.findall(text)
    i = tokens.index("(") if "(" in tokens else 0
    while i < len(tokens):
        t = tokens[i]
        if t == "(" or t == ",":
            parent = at if t == "(" else nodes[at]["parent"]
            nodes.append({"node": len(nodes), "parent": parent, "label": None, "length": 0.0, "meta": {}})
            at = len(nodes) - 1
        elif t == ")":
            at = nodes[at]["parent"]
        elif t == ":":
            while tokens[i + 1].startswith("["):
                nodes[at]["meta"] |= metadata(tokens[i + 1])
                i += 1
            nodes[at]["length"] = float(tokens[i + 1])
            i += 1
        elif t == ";":
            break
        elif t.startswith("["):
            nodes[at]["meta"] |= metadata(t)
        else:
            nodes[at]["label"] = t.strip("'")
        i += 1
    depth = [0.0] * len(nodes)
    for n in nodes[1:]:
        depth[n["node"]] = depth[n["parent"]] + n["length"]
    top = max(depth)
    for n in nodes:
        n["height"] = top - depth[n["node"]]
    return nodes


def metadata(text: str) -> dict[str, str]:
    return {k.strip(): v.strip() for k, v in PAIR.findall(re.sub(r"[\r\n]", "", text).strip("[]").lstrip("&"))}


def translation(lines: list[str]) -> dict[str, str]:
    """Number to label from a Nexus translate block."""
    tokens = TOKEN.findall(" ".join(lines))
    at = next((i for i, t in enumerate(tokens) if t.lower() == "translate"), len(tokens))
    out: dict[str, str] = {}
    pair: list[str] = []
    for t in tokens[at + 1 :]:
        if t in ",;":
            if len(pair) == 2:
                out[pair[0]] = pair[1].strip("'").replace("''", "'")
            pair = []
            if t == ";":
                break
        elif not t.startswith("["):
            pair.append(t)
    return out


#: A record's text without the comments before its first word; a comment that begins with & belongs to what follows.
LEADING = r"^(?:\s|\[(?!&)[^\]]*\])+"


def tree_records(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(tree, text) of each tree in a Newick or Nexus file, numbered along the file, and the labels that a Nexus file translates.

    Trees, translations and comments may go over any number of lines. A Nexus file begins with #NEXUS.
    """
    rows = records(spark, path).select("record", F.regexp_replace("text", LEADING, "").alias("text"))
    nexus = rows.where(F.col("text").rlike(r"(?i)^#NEXUS")).limit(1).count() > 0
    trees = rows.where(F.col("text").rlike(r"(?i)^u?tree[\s*]") if nexus else F.col("text").rlike(r"^(?:\[&[^\]]*\]\s*)*\("))
    labels: dict[str, str] = {}
    if nexus:
        for r in rows.where(F.col("text").rlike(r"(?i)^translate\s")).collect():  # one a file, a name for each taxon
            labels |= translation([r.text + ";"])
    return trees.select(F.col("record").alias("tree"), "text"), labels


def parsed(trees: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Node rows of (tree, text)."""

    columns = ["tree", "node", "parent", "label", "length", "height", "meta"]

    def nodes(frames):
        for frame in frames:
            for tree, text in zip(frame["tree"], frame["text"], strict=True):
                out = [(tree, n["node"], n["parent"], labels.get(n["label"], n["label"]), n["length"], n["height"], n["meta"]) for n in parse(text)]
                yield pd.DataFrame(out, columns=columns).astype({"parent": "Int64"})

    return trees.mapInPandas(nodes, SCHEMA)


def read_trees(spark: SparkSession, path: str, burn_in: float = 0.0) -> DataFrame:
    """Node rows of each tree in a Newick or Nexus file, after dropping the first ``burn_in`` share of trees."""
    trees, labels = tree_records(spark, path)
    if burn_in:
        number = trees.select("tree")
        skip = int(burn_in * number.count())
        if skip:
            first = number.orderBy("tree").limit(skip).agg(F.max("tree").alias("m")).first().m
            trees = trees.where(F.col("tree") > first)
    return parsed(trees, labels)


def read_tree(spark: SparkSession, path: str, taxa: list[str] | None = None) -> DataFrame:
    """Node rows of the one tree in a file; an error if there is none or another.

    With ``taxa`` numbers as labels are places in that list, counted from 0, or from 1 if one is out of range.
    A root with one child is the tree's trunk; it stays a node.
    """
    trees, labels = tree_records(spark, path)
    if (n := trees.count()) != 1:
        raise ValueError(f"Only one input tree is expected, but {n} provided")
    nodes = parsed(trees, labels)
    if taxa is None:
        return nodes
    place = F.when(F.col("label").rlike(r"^\d+$"), F.col("label").cast("int"))
    most = nodes.agg(F.max(place).alias("most")).first().most
    offset = 0 if most is None or most < len(taxa) else 1
    if most is not None and most - offset >= len(taxa):
        raise ValueError(f"Label {most} is not among {len(taxa)} taxa")
    named = F.get(F.array(*[F.lit(t) for t in taxa]), place - offset)
    return nodes.withColumn("label", F.when(place >= offset, named).otherwise(F.col("label")))


def has_trunk(nodes: DataFrame) -> DataFrame:
    """(tree, trunk): whether the root of each tree has one child."""
    children = nodes.where("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    roots = nodes.where("parent IS NULL").select("tree", "node").join(children, ["tree", "node"], "left")
    return roots.select("tree", F.coalesce(F.col("n") == 1, F.lit(False)).alias("trunk"))


def branch_rates(nodes: DataFrame, median: bool = False) -> DataFrame:
    """``nodes`` with ``rate`` from the metadata: the median if asked, else the rate, else 1."""
    found = [F.col("meta")["rate_median"]] if median else []
    return nodes.withColumn("rate", F.coalesce(*[x.cast("double") for x in [*found, F.col("meta")["rate"]]], F.lit(1.0)))


def with_notes(nodes: DataFrame, notes: DataFrame) -> DataFrame:
    """``nodes`` whose ``meta`` also holds ``notes`` (node, key, value; and tree, if the notes differ by tree)."""
    keys = [c for c in ("tree", "node") if c in notes.columns]
    added = notes.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("added"))
    empty = F.create_map().cast("map<string,string>")
    own = F.map_filter(F.coalesce("meta", empty), lambda k, v: ~F.coalesce(F.map_contains_key(F.coalesce("added", empty), k), F.lit(False)))
    return nodes.join(added, keys, "left").withColumn("meta", F.map_concat(own, F.coalesce("added", empty))).drop("added")


def newick(nodes: pd.DataFrame, notes: bool = True) -> str:
    """The Newick text of one tree's rows; metadata as ``[&k=v,...]`` unless left out. Siblings stand as they come."""
    kids: dict = {}
    rows = {r.node: r for r in nodes.itertuples()}
    root = None
    for r in rows.values():
        if r.parent is None or r.parent != r.parent or pd.isna(r.parent):
            root = r.node
        else:
            kids.setdefault(r.parent, []).append(r.node)
    down, todo = [], [root]
    while todo:
        down.append(todo.pop())
        todo += kids.get(down[-1], [])
    text: dict = {}
    for node in reversed(down):  # children first, and no recursion: trees may be of any depth
        r = rows[node]
        inner = f"({','.join(text.pop(c) for c in kids[node])})" if node in kids else ""
        meta = dict(r.meta) if notes and r.meta else {}
        note = f"[&{','.join(f'{k}={v}' for k, v in sorted(meta.items()))}]" if meta else ""
        text[node] = f"{inner}{r.label or ''}{note}:{r.length:.12g}"
    return text[root] + ";"


def to_newick(nodes: DataFrame, notes: bool = True) -> DataFrame:
    """(tree, newick): one text for each tree."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree": [frame["tree"].iloc[0]], "newick": [newick(frame.sort_values("node"), notes)]})

    return nodes.groupBy("tree").applyInPandas(one, "tree bigint, newick string")


def nexus(trees: DataFrame) -> DataFrame:
    """(value): the lines of a Nexus file, in order, for ``write.text``."""
    body = trees.select(F.col("tree").alias("o"), F.concat(F.lit("tree TREE"), F.col("tree").cast("string"), F.lit(" = [&R] "), F.col("newick")).alias("value"))
    head = trees.sparkSession.createDataFrame([(-2, "#NEXUS"), (-1, "Begin trees;")], "o bigint, value string")
    tail = trees.sparkSession.createDataFrame([(2**62, "End;")], "o bigint, value string")
    return head.unionByName(body).unionByName(tail).orderBy("o").select("value")
