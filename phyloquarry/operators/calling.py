"""Variant calling from a tree: the most likely genotypes of all nodes, and what the records of a VCF file take from them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .likelihood import ROWS, Tree, all_partials, first_assignments, gathered, sum_product, tied_assignments, tied_choices

#: Copies of each called pattern that sites with this pattern are spread over.
SALTS = 16
#: Log likelihoods that differ by less are equal: they are sums of many terms of some hundreds.
SLACK = 1e-9
FAR = -1e4


def tree_of(nodes: list[tuple], labels: list[str]) -> Tree:
    """The Tree of (node, parent, length) rows whose tips are ``labels``, in their order."""
    inner = sorted({n for n, _, _ in nodes} - set(labels), key=str)
    place = {n: i for i, n in enumerate([*labels, *inner])}
    if missing := [x for x in labels if x not in {n for n, _, _ in nodes}]:
        raise ValueError(f"Not in the tree: {missing[0]}")
    parent, length = [-1] * len(place), [0.0] * len(place)
    for n, p, t in nodes:
        parent[place[n]], length[place[n]] = place[p] if p is not None else -1, float(t or 0.0)
    return Tree(tuple(parent), tuple(length), len(labels))


#: Calls of patterns by place: (pattern, option, category, log likelihood, constant, states of the nodes, tips' transitions).
Calls = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Tips of all patterns that are evaluated at once.
TIPS = 200_000


def calls_of(leaves: np.ndarray, tree: Tree, matrices: list[list[np.ndarray]], shares: list[float], root_state: int = 0) -> Iterator[Calls]:
    """The calls of patterns, as told in ``called``, from their tips' log likelihoods (tips x patterns x states).

    Patterns of one best category and one best assignment, as most are, are found as arrays; ties are walked.
    """
    states, n_nodes, n = leaves.shape[2], len(tree.parent), leaves.shape[1]
    with np.errstate(divide="ignore"):
        log_p = [[np.log(m) for m in matrix] for matrix in matrices]
    up = [tree.parent[i] for i in range(tree.n_tips)]
    each = np.arange(n_nodes)

    def transfer(c: int, own: np.ndarray) -> np.ndarray:
        found = np.stack([log_p[c][i][own[:, up[i]]] for i in range(tree.n_tips)], axis=1)
        return np.maximum(found.reshape(len(own), tree.n_tips * states), -745.0)

    def scored(nodes: np.ndarray, found: Iterator[tuple[int, ...]]) -> Iterator[tuple[float, tuple[int, ...]]]:
        for a in found:
            own = nodes[each, list(a)]
            top = own.max()
            yield float(top + np.log(np.exp(own - top).sum())) if np.isfinite(top) else float(top), a

    masked = np.where(np.arange(states) == root_state, leaves, FAR)
    whole = np.stack([math.log(s) + sum_product(leaves, tree, m)[:, root_state] for m, s in zip(matrices, shares, strict=True)])
    top = whole.max(0)
    total = top + np.log(np.exp(whole - top).sum(0))
    best = whole >= top - SLACK
    single = best.sum(0) == 1
    walked: dict[int, list[tuple]] = {}
    for c, matrix in enumerate(matrices):
        at = np.flatnonzero(best[c])
        if not len(at):
            continue
        constant = sum_product(masked[:, at], tree, matrix)[:, root_state]
        own, only = first_assignments(tree, tied_choices(leaves[:, at], tree, matrix, SLACK)[1], len(at), root_state)
        plain = only & single[at]
        if plain.any():
            k = at[plain]
            yield k, np.zeros(len(k), int), np.full(len(k), c), total[k], constant[plain], own[plain], transfer(c, own[plain])
        rest, constant = at[~plain], constant[~plain]
        if not len(rest):
            continue
        by_node = all_partials(leaves[:, rest], tree, matrix)
        nodes = np.stack([by_node[i] for i in range(n_nodes)])
        twice = zip(*(tied_assignments(leaves[:, rest], tree, matrix, root_state, SLACK) for _ in range(2)), strict=True)
        for j, (k, ((_, first), (_, again))) in enumerate(zip(rest.tolist(), twice, strict=True)):
            most = max((score for score, _ in scored(nodes[:, j], first)), default=0.0)
            walked.setdefault(k, []).append((most, c, float(constant[j]), nodes[:, j], again))

    def tied() -> Iterator[tuple]:
        for k, ways in walked.items():
            most = max(x[0] for x in ways)
            option = 0
            for score, c, constant, nodes, again in ways:
                if score < most - SLACK:
                    continue
                for own, a in scored(nodes, again):
                    if own >= most - SLACK:
                        yield k, option, c, total[k], constant, a
                        option += 1

    found = tied()
    while part := list(islice(found, ROWS)):
        k, option, category, likelihood, constant, own = (np.array(x) for x in zip(*part, strict=True))
        steps = np.empty((len(k), tree.n_tips * states))
        for c in range(len(matrices)):
            steps[category == c] = transfer(c, own[category == c])
        yield k, option, category, likelihood, constant, own, steps


def called(partials: DataFrame, tree: Tree, matrices: list[list[np.ndarray]], shares: list[float], root_state: int = 0) -> DataFrame:
    """(pattern, option, category, log_likelihood, constant, states, transfer): the calls of each pattern.

    A pattern's categories of the largest likelihood are taken (ties all), in them all most likely assignments, and of
    these the ones of the largest log-sum of the nodes' partial likelihoods; equal ones are options 0, 1, ... ``states``
    holds every node's genotype, tips first; ``transfer`` each tip's log transitions from its parent's genotype, state by
    state; ``constant`` is the log likelihood of a site at which all tips have the root's genotype. A pattern's ties are
    walked twice, so that one at a time is held.
    """
    states = len(matrices[0][0])

    def batchwise(frames):
        for frame in frames:
            leaves = np.stack(frame["leaves"]).astype(float).reshape(len(frame), tree.n_tips, states).transpose(1, 0, 2)
            for k, option, category, total, constant, own, transfer in calls_of(leaves, tree, matrices, shares, root_state):
                given = {"pattern": frame["pattern"].to_numpy()[k], "option": option, "category": category, "log_likelihood": total, "constant": constant}
                yield pd.DataFrame(given | {"states": list(own), "transfer": list(transfer)})

    kind = partials.schema["pattern"].dataType.simpleString()
    return gathered(partials).mapInPandas(batchwise, f"pattern {kind}, option int, category int, log_likelihood double, constant double, states array<int>, transfer array<double>")


def called_columns(columns: DataFrame, width: int, leaf: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], tree: Tree, matrices: list[list[np.ndarray]], shares: list[float], root_state: int = 0) -> DataFrame:
    """``columns`` with (option, constant, genotypes, liks, ado, ado_liks): a row for each call of each site, its cells in arrays.

    ``columns`` has a row for each site, with ``counts``: ``width`` numbers a cell, cells in the order of the tips. ``leaf``
    gives of such numbers (cells x width) the genotype log likelihoods (cells x states) and their components by dropout
    state (cells x states x dropout states). What is told is that of ``called_cells``, without any row for a pattern:
    each site is called from its own counts, so nothing is shuffled and no pattern meets in one task. ``liks`` and
    ``ado_liks`` hold the values of the first cell, then those of the second, and so on.
    """
    number, real = T.IntegerType(), T.DoubleType()
    told = {"option": number, "constant": real, "genotypes": T.ArrayType(number), "liks": T.ArrayType(real), "ado": T.ArrayType(number), "ado_liks": T.ArrayType(real)}
    schema = T.StructType([*columns.schema.fields, *[T.StructField(name, kind) for name, kind in told.items()]])
    n_tips, step = tree.n_tips, max(1, TIPS // tree.n_tips)

    def listed(values: np.ndarray) -> pa.Array:
        flat = values.reshape(len(values), -1)
        return pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * np.int32(flat.shape[1]), pa.array(flat.ravel()))

    def found(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = batch.column("counts")
        if set(pc.list_value_length(counts).to_pylist()) - {n_tips * width}:
            raise ValueError(f"A site without the counts of all {n_tips} cells")
        distinct, place = np.unique(counts.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), axis=0, return_inverse=True)
        lik, parts = leaf(distinct)
        place = place.reshape(batch.num_rows, n_tips)
        for k, option, _, _, constant, own, transfer in calls_of(lik[place].transpose(1, 0, 2), tree, matrices, shares, root_state):
            genotypes = own[:, :n_tips]
            ado_liks = parts[place[k], genotypes]
            new = [pa.array(option, pa.int32()), pa.array(constant, pa.float64()), listed(genotypes.astype(np.int32)), listed(lik[place[k]].reshape(len(k), -1) + transfer), listed(ado_liks.argmax(2).astype(np.int32)), listed(ado_liks)]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(k)).columns, *new], names=schema.names)

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                yield from found(batch.slice(i, step))

    return columns.mapInArrow(batchwise, schema)


def called_cells(calls: DataFrame, sites: DataFrame, cells: DataFrame, states: int = 4) -> DataFrame:
    """(site, option, cell, genotype, liks, ado, ado_liks, constant): patterns' calls brought back to sites and cells.

    ``sites`` has (site, pattern); ``cells`` (site, cell, place, lik, parts), the place being the tip's, ``lik`` the
    cell's genotype log likelihoods and ``parts`` the components of each by dropout state. ``liks`` adds the transition
    from the parent's genotype; the dropout state is the most likely component of the called genotype.
    """
    salted = sites.select("site", "pattern", F.pmod(F.xxhash64("site"), F.lit(SALTS)).alias("salt"))
    spread = calls.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    per_site = salted.join(spread, ["pattern", "salt"]).select("site", "option", "states", "transfer", "constant")
    met = cells.join(per_site, "site")
    genotype = F.get("states", F.col("place"))
    met = met.withColumn("genotype", genotype).withColumn("ado_liks", F.get("parts", genotype))
    liks = F.transform("lik", lambda x, i: x + F.get("transfer", F.col("place") * states + i))
    return met.select("site", "option", "cell", "genotype", liks.alias("liks"), (F.array_position("ado_liks", F.array_max("ado_liks")) - 1).cast("int").alias("ado"), "ado_liks", "constant")
