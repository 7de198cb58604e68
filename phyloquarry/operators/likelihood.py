"""Tree likelihoods by message passing, vectorised over site patterns.

The tree and its transition matrices are small and go to every task; patterns are rows. A task turns a batch of
patterns into one array (patterns x genotypes for each node) and passes messages from the tips to the root, so the
work is spread over patterns and no shuffle follows the one that gathers a pattern's cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Assignments handed on at once.
ROWS = 10_000

#: Relative rates between genotypes, by row; the diagonal is left out.
RATES = {
    4: [[1, 0, 0], [1 / 6, 1 / 6, 1 / 3], [0, 1 / 3, 2 / 3], [0, 1 / 3, 1 / 3]],
    3: [[1, 0], [1 / 6, 1 / 2], [0, 1 / 3]],
}


def rate_matrix(states: int = 4) -> np.ndarray:
    """The generator, divided by the plain sum of the exit rates."""
    q = np.zeros((states, states))
    for i, row in enumerate(RATES[states]):
        q[i, [j for j in range(states) if j != i]] = row
    exits = q.sum(1)
    return (q - np.diag(exits)) / exits.sum()


def rate_table(spark, states: int = 4) -> DataFrame:
    """(p, c, rate): the generator's rates between unlike genotypes, by name."""
    q = rate_matrix(states)
    names = ["0/0", "0/1", "1/1", "1/2"][:states]
    return spark.createDataFrame([(a, b, float(q[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i != j], "p string, c string, rate double")


def transition(q: np.ndarray, time: float) -> np.ndarray:
    """exp(q time) by scaling and squaring of the Taylor series."""
    a = q * time
    halvings = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(1).max(), 1e-300)))) + 4)
    a = a / 2.0**halvings
    term = out = np.eye(len(a))
    for k in range(1, 16):
        term = term @ a / k
        out = out + term
    for _ in range(halvings):
        out = out @ out
    return np.clip(out, 0, None)


def gamma_rates(shape: float, categories: int) -> np.ndarray:
    """Medians of equal-probability gamma categories, scaled to a mean of 1; the shape is kept within 1e-3 .. 1e3."""
    shape = min(max(shape, 1e-3), 1e3)
    points = np.array([quantile((2 * i + 1) / (2 * categories), shape) for i in range(categories)])
    return points * categories / points.sum()


def sampled_rates(shapes: DataFrame, categories: int) -> DataFrame:
    """``shapes`` (.., shape) with ``category`` and ``rate``; each distinct shape is worked out once and joined back."""

    def rows(frames):
        for frame in frames:
            found = [(s, k, float(r)) for s in frame["shape"] for k, r in enumerate(gamma_rates(s, categories))]
            yield pd.DataFrame(found, columns=["shape", "category", "rate"])

    distinct = shapes.select(F.col("shape").cast("double").alias("shape")).where("shape IS NOT NULL").distinct()
    return shapes.join(distinct.mapInPandas(rows, "shape double, category int, rate double"), "shape")


def quantile(p: float, shape: float) -> float:
    """The gamma(shape, 1) quantile, by bisection on the regularised incomplete gamma function."""
    low, high = 0.0, max(shape * 4 + 50, 10.0)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_gamma(shape, mid) < p else (low, mid)
    return (low + high) / 2


def incomplete_gamma(a: float, x: float) -> float:
    """P(a, x), by its series below a + 1 and a continued fraction above."""
    from math import exp, lgamma, log

    if x <= 0:
        return 0.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


@dataclass(frozen=True)
class Tree:
    """Nodes in an order in which children come before parents; tips are 0 .. n_tips - 1 in cell order."""

    parent: tuple[int, ...]
    length: tuple[float, ...]
    n_tips: int

    @cached_property
    def _children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.parent]
        for i, p in enumerate(self.parent):
            if p >= 0:
                out[p].append(i)
        return out

    def children(self, node: int) -> list[int]:
        return self._children[node]

    @property
    def root(self) -> int:
        return self.parent.index(-1)

    def order(self) -> list[int]:
        """Inner nodes, children first."""
        out, todo = [], [self.root]
        while todo:
            out.append(todo.pop())
            todo += self.children(out[-1])
        return [n for n in reversed(out) if n >= self.n_tips]


def log_messages(child: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """ln sum_h P(g -> h) exp(child[h]) for each pattern and parent genotype."""
    both = child[:, None, :] + log_p[None]
    most = both.max(2, keepdims=True)
    most = np.where(np.isfinite(most), most, 0)
    return most[..., 0] + np.log(np.exp(both - most).sum(2))


def all_partials(leaves: np.ndarray, tree: Tree, matrices: list[np.ndarray]) -> dict[int, np.ndarray]:
    """ln partial likelihoods (patterns x genotypes) of each node from tips' (tips x patterns x genotypes)."""
    with np.errstate(divide="ignore"):
        log_p = [np.log(m) for m in matrices]
    partial = {i: leaves[i] for i in range(tree.n_tips)}
    for node in tree.order():
        partial[node] = sum(log_messages(partial[c], log_p[c]) for c in tree.children(node))
    return partial


def sum_product(leaves: np.ndarray, tree: Tree, matrices: list[np.ndarray]) -> np.ndarray:
    """``all_partials`` at the root."""
    return all_partials(leaves, tree, matrices)[tree.root]


def tied_choices(leaves: np.ndarray, tree: Tree, matrices: list[np.ndarray], slack: float) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The best log likelihoods (patterns x genotypes) at the root, and of each node below it (patterns x parent's x own genotypes) which reach the best to ``slack``."""
    with np.errstate(divide="ignore"):
        log_p = [np.log(m) for m in matrices]
    best = {i: leaves[i] for i in range(tree.n_tips)}
    ties: dict[int, np.ndarray] = {}
    for node in tree.order():
        total = 0
        for c in tree.children(node):
            both = best[c][:, None, :] + log_p[c][None]
            top = both.max(2)
            ties[c] = both >= top[..., None] - slack
            total = total + top
        best[node] = total
    return best[tree.root], ties


def downward(tree: Tree) -> list[int]:
    """Nodes, parents first."""
    down, todo = [], [tree.root]
    while todo:
        down.append(todo.pop())
        todo += reversed(tree.children(down[-1]))
    return down


def first_assignments(tree: Tree, ties: dict[int, np.ndarray], n: int, root_state: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of each of ``n`` patterns the first of the assignments that ``tied_choices`` leaves (patterns x nodes), and whether it is the only one."""
    states, only, each = np.full((n, len(tree.parent)), root_state), np.ones(n, bool), np.arange(n)
    for node in downward(tree)[1:]:
        choice = ties[node][each, states[:, tree.parent[node]]]
        states[:, node] = choice.argmax(1)
        only &= choice.sum(1) == 1
    return states, only


def tied_assignments(leaves: np.ndarray, tree: Tree, matrices: list[np.ndarray], root_state: int = 0, slack: float = 1e-12) -> Iterator[tuple[float, Iterator[tuple[int, ...]]]]:
    """For each pattern the best log likelihood and, one at a time, all assignments of genotypes to nodes that reach it to ``slack``."""
    best, ties = tied_choices(leaves, tree, matrices, slack)
    down = downward(tree)

    def walk(k: int) -> Iterator[tuple[int, ...]]:
        """Every choice at a node goes on to at least one below, so nothing but the path is held."""
        state = [root_state] * len(tree.parent)
        choices = [iter([root_state])]
        while choices:
            node = down[len(choices) - 1]
            if (g := next(choices[-1], None)) is None:
                choices.pop()
                continue
            state[node] = g
            if len(choices) == len(down):
                yield tuple(state)
            else:
                below = down[len(choices)]
                choices.append(iter(np.flatnonzero(ties[below][k, state[tree.parent[below]]]).tolist()))

    for k in range(leaves.shape[1]):
        yield float(best[k, root_state]), walk(k)


def max_sum(leaves: np.ndarray, tree: Tree, matrices: list[np.ndarray], root_state: int = 0, most: int | None = None) -> list[tuple[float, list[tuple[int, ...]]]]:
    """``tied_assignments`` as lists, of all ties or the first ``most``."""
    return [(score, list(islice(found, most))) for score, found in tied_assignments(leaves, tree, matrices, root_state)]


def gathered(partials: DataFrame) -> DataFrame:
    """(pattern, leaves): the tips' genotype log likelihoods in cell order, flattened; ``partials`` has an array ``lik``."""
    cells = F.array_sort(F.collect_list(F.struct("cell", "lik")))
    return partials.groupBy("pattern").agg(F.flatten(F.transform(cells, lambda x: x["lik"])).alias("leaves"))


def pattern_log_likelihoods(partials: DataFrame, tree: Tree, matrices: list[list[np.ndarray]], proportions: list[float], frequencies: list[float]) -> DataFrame:
    """(pattern, log_likelihood): summed over rate categories (their matrices and shares) and root genotypes."""
    states = len(frequencies)

    def batchwise(frames):
        for frame in frames:
            leaves = np.stack(frame["leaves"]).astype(float).reshape(len(frame), tree.n_tips, states).transpose(1, 0, 2)
            with np.errstate(divide="ignore"):
                parts = [np.log(share) + np.log(frequencies)[None] + sum_product(leaves, tree, m) for m, share in zip(matrices, proportions, strict=True)]
            both = np.concatenate(parts, axis=1)
            top = both.max(1)
            yield pd.DataFrame({"pattern": frame["pattern"], "log_likelihood": top + np.log(np.exp(both - top[:, None]).sum(1))})

    kind = partials.schema["pattern"].dataType.simpleString()
    return gathered(partials).mapInPandas(batchwise, f"pattern {kind}, log_likelihood double")


def best_assignments(partials: DataFrame, tree: Tree, matrices: list[np.ndarray], states: int = 4) -> DataFrame:
    """(pattern, log_likelihood, assignment): every most likely assignment, genotypes joined by commas in node order."""

    def batchwise(frames):
        for frame in frames:
            leaves = np.stack(frame["leaves"]).astype(float).reshape(len(frame), tree.n_tips, states).transpose(1, 0, 2)
            rows = ((p, s, ",".join(map(str, a))) for p, (s, found) in zip(frame["pattern"], tied_assignments(leaves, tree, matrices), strict=True) for a in found)
            while part := list(islice(rows, ROWS)):
                yield pd.DataFrame(part, columns=["pattern", "log_likelihood", "assignment"])

    kind = partials.schema["pattern"].dataType.simpleString()
    return gathered(partials).mapInPandas(batchwise, f"pattern {kind}, log_likelihood double, assignment string")


def chosen_assignments(partials: DataFrame, tree: Tree, matrices: list[np.ndarray], states: int = 4) -> DataFrame:
    """(pattern, log_likelihood, assignment, node_score): of the most likely assignments those of the largest score.

    The score is the log-sum of the partial likelihoods of the nodes' genotypes. Equal scores all stay. A pattern's
    ties are walked twice, first for the largest score, so that no more than one of them is held.
    """

    def scored(nodes: np.ndarray, found: Iterator[tuple[int, ...]]) -> Iterator[tuple[float, tuple[int, ...]]]:
        each = np.arange(len(tree.parent))
        for a in found:
            own = nodes[each, list(a)]
            top = own.max()
            yield float(top + np.log(np.exp(own - top).sum())) if np.isfinite(top) else float(top), a

    def rows(frame: pd.DataFrame) -> Iterator[tuple]:
        leaves = np.stack(frame["leaves"]).astype(float).reshape(len(frame), tree.n_tips, states).transpose(1, 0, 2)
        by_node = all_partials(leaves, tree, matrices)
        nodes = np.stack([by_node[i] for i in range(len(tree.parent))])
        twice = zip(tied_assignments(leaves, tree, matrices), tied_assignments(leaves, tree, matrices), strict=True)
        for k, (pattern, ((best, first), (_, again))) in enumerate(zip(frame["pattern"], twice, strict=True)):
            most = max((score for score, _ in scored(nodes[:, k], first)), default=0.0)
            for score, a in scored(nodes[:, k], again):
                if score >= most - 1e-12:
                    yield pattern, best, ",".join(map(str, a)), score

    def batchwise(frames):
        for frame in frames:
            found = rows(frame)
            while part := list(islice(found, ROWS)):
                yield pd.DataFrame(part, columns=["pattern", "log_likelihood", "assignment", "node_score"])

    kind = partials.schema["pattern"].dataType.simpleString()
    return gathered(partials).mapInPandas(batchwise, f"pattern {kind}, log_likelihood double, assignment string, node_score double")


def weighted_log_likelihood(patterns: DataFrame) -> DataFrame:
    """One row: the sum of pattern log likelihoods times weights."""
    return patterns.agg(F.sum(F.col("log_likelihood") * F.col("weight")).alias("log_likelihood"))


def ascertainment(patterns: DataFrame, kind: str, n_background: float = 0.0) -> DataFrame:
    """One row: the correction from ``constant`` (log likelihood of a constant site) under each pattern.

    lewis: -sum w ln(1 - e^c); mean: (ln sum e^c - ln L) B; geometric: (sum c) B / L, over L loci by weight.
    """
    c, w = F.col("constant"), F.col("weight")
    if kind == "lewis":
        return patterns.agg((-F.sum(w * F.log(1 - F.exp(c)))).alias("correction"))
    if kind == "geometric":
        return patterns.agg((F.sum(w * c) * n_background / F.sum(w)).alias("correction"))
    most = patterns.agg(F.max("constant").alias("most"), F.sum("weight").alias("loci"))
    joined = patterns.crossJoin(F.broadcast(most))  # one row
    return joined.groupBy("most", "loci").agg(F.sum(w * F.exp(c - F.col("most"))).alias("s")).select(((F.col("most") + F.log("s") - F.log("loci")) * n_background).alias("correction"))


def recombined(roots: DataFrame, subtrees: DataFrame, inside: list[int], node: int) -> DataFrame:
    """(pattern, assignment): each of ``roots`` with the nodes ``inside`` taken from each of ``subtrees`` that agrees at ``node``.

    Both have an array ``assignment``, by node. Each is cut to the nodes it gives before they meet, so that no pair
    is made twice and the result needs no further comparison.
    """
    state = F.get("assignment", F.lit(node)).alias("state")

    def given(side: DataFrame, inner: bool) -> DataFrame:
        kept = F.transform("assignment", lambda g, i: F.when(i.isin(inside) == F.lit(inner), g))
        return side.select("pattern", state, kept.alias("inner" if inner else "outer")).distinct()

    met = given(roots, False).join(given(subtrees, True), ["pattern", "state"])
    return met.select("pattern", F.zip_with("inner", "outer", lambda a, b: F.coalesce(a, b)).alias("assignment"))


def calling_log_likelihood(patterns: DataFrame, kind: str | None = None, n_background: float = 0.0) -> DataFrame:
    """One row: the weighted log likelihood of patterns with the ``ascertainment`` of ``kind``, the posterior of variant calling."""
    total = weighted_log_likelihood(patterns)
    if kind is None:
        return total
    both = total.crossJoin(F.broadcast(ascertainment(patterns, kind, n_background)))  # a row each
    return both.select((F.col("log_likelihood") + F.col("correction")).alias("log_likelihood"))
