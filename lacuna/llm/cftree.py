"""Mergeable cluster-feature trees and Ward agglomeration of their leaf entries.

A cluster feature is (n, linear sum, square sum); two features merge by addition. Trees are built per
partition, their leaf entries are the summary, and summaries merge by inserting entries into a new tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARY = "cell int, part int, n double, ls array<double>, ss double"


class _Node:
    __slots__ = ("count", "cents", "ns", "kids", "sums")

    def __init__(self, branching: int, dim: int, leaf: bool):
        self.count = 0
        self.cents = np.zeros((branching + 1, dim))
        self.sums = np.zeros((branching + 1, dim))
        self.ns = np.zeros(branching + 1)
        self.kids: list = []  # child nodes, or numbers of leaf entries
        if leaf:
            self.kids = []


class CFTree:
    """A cluster-feature tree over the rows it is given.

    A row joins the nearest leaf entry that the descent finds if its distance to that entry's centroid is
    at most ``threshold``, else it opens a new entry. Beyond ``max_leaves`` entries they are condensed, so
    memory is bounded whatever the input. ``alike``: distance up to which the threshold may rise.
    """

    def __init__(self, dim: int, threshold: float, max_leaves: int = 2048, branching: int = 32, alike: float = 0.6):
        self.dim, self.threshold, self.max_leaves, self.branching, self.alike = dim, threshold, max_leaves, branching, alike
        self._clear()

    def _clear(self) -> None:
        self.root, self.leaf_level = _Node(self.branching, self.dim, True), 0
        self.n: list[float] = []
        self.ss: list[float] = []
        self.ls: list[np.ndarray] = []

    def insert(self, x: np.ndarray, n: float = 1.0, ss: float | None = None) -> int:
        """Adds a feature with linear sum ``x``; returns the number of the leaf entry it joined."""
        ss = float(x @ x) if ss is None else ss
        c = x / n
        entry, split = self._into(self.root, self.leaf_level, x, c, n, ss)
        if split is not None:
            old, root = self.root, _Node(self.branching, self.dim, False)
            for node in (old, split):
                self._add(root, node, node.sums[: node.count].sum(axis=0), node.ns[: node.count].sum())
            self.root, self.leaf_level = root, self.leaf_level + 1
        return entry

    @staticmethod
    def _add(node: _Node, kid, s: np.ndarray, n: float) -> None:
        k = node.count
        node.sums[k], node.ns[k], node.cents[k] = s, n, s / n
        node.kids.append(kid)
        node.count = k + 1

    def _nearest(self, node: _Node, c: np.ndarray) -> tuple[int, float]:
        gap = node.cents[: node.count] - c
        d = np.einsum("ij,ij->i", gap, gap)
        k = int(d.argmin())
        return k, float(d[k])

    def _into(self, node: _Node, level: int, x, c, n, ss):
        if level == 0:
            if node.count:
                k, d = self._nearest(node, c)
                if d <= self.threshold**2:
                    e = node.kids[k]
                    self.n[e] += n
                    self.ss[e] += ss
                    self.ls[e] += x
                    node.sums[k] += x
                    node.ns[k] += n
                    node.cents[k] = node.sums[k] / node.ns[k]
                    return e, None
            e = len(self.n)
            self.n.append(n)
            self.ss.append(ss)
            self.ls.append(x.copy())
            self._add(node, e, x, n)
        else:
            k, _ = self._nearest(node, c)
            e, split = self._into(node.kids[k], level - 1, x, c, n, ss)
            kid = node.kids[k]
            if split is None:
                node.sums[k] += x
                node.ns[k] += n
            else:
                node.sums[k] = kid.sums[: kid.count].sum(axis=0)
                node.ns[k] = kid.ns[: kid.count].sum()
                self._add(node, split, split.sums[: split.count].sum(axis=0), split.ns[: split.count].sum())
            node.cents[k] = node.sums[k] / node.ns[k]
        return e, self._split(node) if node.count > self.branching else None

    def _split(self, node: _Node) -> _Node:
        """Moves about half of the node's entries, by the farthest pair, to the node it returns."""
        m = node.cents[: node.count]
        sq = np.einsum("ij,ij->i", m, m)
        d = sq[:, None] + sq[None, :] - 2 * m @ m.T
        a, b = divmod(int(d.argmax()), node.count)
        to_b = d[:, b] < d[:, a]
        if to_b.all() or not to_b.any():  # all alike
            to_b = np.arange(node.count) >= node.count // 2
        parts = []
        for side in (~to_b, to_b):
            part = _Node(self.branching, self.dim, False)
            for i in np.flatnonzero(side):
                self._add(part, node.kids[i], node.sums[i], node.ns[i])
            parts.append(part)
        node.count, node.cents, node.sums, node.ns, node.kids = parts[0].count, parts[0].cents, parts[0].sums, parts[0].ns, parts[0].kids
        return parts[1]

    def insert_rows(self, rows: np.ndarray, n: np.ndarray | None = None, ss: np.ndarray | None = None) -> None:
        for i in range(len(rows)):
            self.insert(rows[i], 1.0 if n is None else float(n[i]), None if ss is None else float(ss[i]))
            if len(self.n) > self.max_leaves:
                self._condense()

    def _condense(self) -> None:
        """Brings the entries down to half of ``max_leaves``.

        The threshold rises by quantiles of the distance to the nearest entry, but not beyond ``alike``:
        there the distances between unlike entries begin, which differ so little that any entry would
        soon absorb all. From then on the cheapest pairs by Ward's cost merge, each entry once a round.
        """
        while len(self.n) > self.max_leaves // 2:
            ls, n, ss = np.array(self.ls), np.array(self.n), np.array(self.ss)
            rise = float(np.quantile(nearest_distance(ls / n[:, None]), 0.3))
            if max(rise, self.threshold * 1.05) <= self.alike:
                self.threshold = max(rise, self.threshold * 1.05, 1e-6)
            else:
                ls, n, ss = merge_pairs(ls, n, ss, len(n) - self.max_leaves // 2)
            self._clear()
            for i in range(len(n)):
                self.insert(ls[i], float(n[i]), float(ss[i]))

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, linear sums, square sums) of the leaf entries."""
        return np.array(self.n), np.array(self.ls).reshape(len(self.n), self.dim), np.array(self.ss)


def merge_pairs(ls: np.ndarray, n: np.ndarray, ss: np.ndarray, wanted: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features after merging up to ``wanted`` disjoint pairs, cheapest by Ward's cost first."""
    c = ls / n[:, None]
    sq = np.einsum("ij,ij->i", c, c)
    best, cost = np.empty(len(n), int), np.empty(len(n))
    for i in range(0, len(n), block):
        m = n[i : i + block, None]
        d = np.maximum(sq[i : i + block, None] + sq[None, :] - 2 * c[i : i + block] @ c.T, 0) * (m * n / (m + n))
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        best[i : i + block], cost[i : i + block] = d.argmin(axis=1), d.min(axis=1)
    keep, done = np.ones(len(n), bool), np.zeros(len(n), bool)
    ls, n, ss = ls.copy(), n.copy(), ss.copy()
    for i in np.argsort(cost, kind="stable"):
        j = best[i]
        if wanted and not done[i] and not done[j]:
            done[i] = done[j] = True
            ls[i] += ls[j]
            n[i] += n[j]
            ss[i] += ss[j]
            keep[j] = False
            wanted -= 1
    return ls[keep], n[keep], ss[keep]


def nearest_distance(c: np.ndarray, block: int = 1024) -> np.ndarray:
    sq = np.einsum("ij,ij->i", c, c)
    out = np.empty(len(c))
    for i in range(0, len(c), block):
        d = sq[i : i + block, None] + sq[None, :] - 2 * c[i : i + block] @ c.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + block] = np.sqrt(np.maximum(d.min(axis=1), 0))
    return out


def ward(cents: np.ndarray, mass: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges ``(a, b, cost)`` of Ward's agglomeration, cheapest first, by the nearest-neighbour chain.

    a and b are row numbers of members of the two sides. O(m^2) time and O(m) memory. Ties go to the
    lower row number, so the result is fixed by the order of the rows.
    """
    m = len(cents)
    c, w = cents.astype(float).copy(), mass.astype(float).copy()
    sq = np.einsum("ij,ij->i", c, c)
    alive = np.ones(m, bool)
    merges: list[tuple[int, int, float]] = []
    chain: list[int] = []
    first = 0
    while len(merges) < m - 1:
        if not chain:
            while not alive[first]:
                first += 1
            chain.append(first)
        while True:
            i = chain[-1]
            cost = (w * w[i] / (w + w[i])) * np.maximum(sq + sq[i] - 2 * (c @ c[i]), 0)
            cost[~alive] = np.inf
            cost[i] = np.inf
            j = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        a, b = min(i, j), max(i, j)
        merges.append((a, b, float(cost[j])))
        c[a] = (w[a] * c[a] + w[b] * c[b]) / (w[a] + w[b])
        w[a] += w[b]
        sq[a] = c[a] @ c[a]
        alive[b] = False
    return sorted(merges, key=lambda x: x[2])


def cut(m: int, merges: list[tuple[int, int, float]], k: int) -> np.ndarray:
    """Group numbers (0..k-1, by first member) of m rows after all but the k - 1 dearest merges."""
    root = np.arange(m)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, _ in merges[: max(0, m - max(1, k))]:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    roots = np.array([find(i) for i in range(m)], dtype=int)
    return np.unique(roots, return_inverse=True)[1]


def components(f: np.ndarray, min_similarity: float, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors linked by similarities of at least that: the smallest number of each row's component, and whether all rows of it are alike.

    Memory is one block of similarities.
    """
    m = len(f)
    f = f.astype(np.float32)
    roots, links = np.arange(m), np.ones(m, int)
    for i in range(0, m, block):
        near = f[i : i + block] @ f.T >= min_similarity
        near[np.arange(len(near)), np.arange(i, i + len(near))] = True
        roots[i : i + block] = near.argmax(axis=1)
        links[i : i + block] = np.count_nonzero(near, axis=1)
    some = np.flatnonzero(links > 1)  # rows without a link stay alone, so only the others are met again
    f = f[some]
    while len(some):  # the smallest number of a linked row spreads, and numbers follow their own number
        while (roots[roots] != roots).any():
            roots = roots[roots]
        if (np.bincount(roots, minlength=m)[roots[some]] == links[some]).all():  # every row is linked to its whole component
            break
        before = roots[some]
        for i in range(0, len(some), block):
            near = f[i : i + block] @ f.T >= min_similarity
            near[np.arange(len(near)), np.arange(i, i + len(near))] = True
            roots[some[i : i + block]] = np.where(near, roots[some][None, :], m).min(axis=1)
        if (roots[some] == before).all():
            break
    part = np.bincount(roots, links != np.bincount(roots, minlength=m)[roots], minlength=m)
    return roots, part[roots] == 0


def alike_groups(cents: np.ndarray, mass: np.ndarray, min_similarity: float, block: int = 512) -> np.ndarray:
    """Group numbers of unit centroids: Ward's merges whose two sides have a similarity of at least that.

    Only centroids linked by such similarities can end in one group, so the agglomeration runs inside
    each linked component. Where all of a component are alike, so are the sides of every merge: it is one group.
    """
    roots, whole = components(cents, min_similarity, block)
    label = roots.copy()
    order = np.flatnonzero(~whole)
    order = order[np.argsort(roots[order], kind="stable")]
    bounds = np.flatnonzero(np.diff(roots[order])) + 1
    for part in np.split(order, bounds) if len(order) else []:
        c, w = cents[part].astype(float), mass[part].astype(float)
        mine = np.arange(len(part))
        sums, total = c * w[:, None], w.copy()
        for a, b, _ in ward(c, w):
            ra, rb = mine[a], mine[b]
            if ra == rb:
                continue
            sim = sums[ra] @ sums[rb] / max(1e-300, np.linalg.norm(sums[ra]) * np.linalg.norm(sums[rb]))
            if sim >= min_similarity:
                lo, hi = min(ra, rb), max(ra, rb)
                mine[mine == hi] = lo
                sums[lo] += sums[hi]
                total[lo] += total[hi]
        label[part] = part[mine]
    return label


def like_rows(rows: np.ndarray, threshold: float, min_similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf entries (n, linear sums, square sums) of like rows: a component whose rows are all alike is one, the other rows go into a tree."""
    roots, whole = components(rows, min_similarity)
    tree = CFTree(rows.shape[1], threshold, 1 << 62)
    tree.insert_rows(rows[~whole])
    order = np.flatnonzero(whole)
    order = order[np.argsort(roots[order], kind="stable")]
    starts = np.flatnonzero(np.diff(roots[order], prepend=-1))
    if not len(starts):
        return tree.entries()
    square = np.einsum("ij,ij->i", rows, rows)
    own = np.diff(starts, append=len(order)).astype(float), np.add.reduceat(rows[order], starts), np.add.reduceat(square[order], starts)
    return tuple(np.concatenate(x) for x in zip(own, tree.entries()))


def bulk(ls: np.ndarray, n: np.ndarray, ss: np.ndarray, max_leaves: int, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``max_leaves`` features that hold all the given ones: leaf entries of a tree of two levels built at once.

    A node's children start from features evenly spaced in the given order and move to the means of what is nearest.
    """
    m = len(n)
    if m <= max_leaves:
        return ls, n, ss
    c = (ls / n[:, None]).astype(np.float32)
    tops = math.isqrt(max_leaves - 1) + 1
    top = _dealt(c, n, tops, rounds)
    label, used = np.empty(m, int), 0
    for i in range(tops):
        rows = np.flatnonzero(top == i)
        if len(rows):
            k = (max_leaves - tops) * len(rows) // m + 1
            label[rows] = used + _dealt(c[rows], n[rows], k, rounds)
            used += k
    order = np.argsort(label, kind="stable")
    starts = np.flatnonzero(np.diff(label[order], prepend=-1))
    return tuple(np.add.reduceat(x[order], starts) for x in (ls, n, ss))


def _dealt(c: np.ndarray, n: np.ndarray, k: int, rounds: int, block: int = 4096) -> np.ndarray:
    """The number (0..k-1) of the nearest of k means for each row."""
    centres = c[np.linspace(0, len(c) - 1, min(k, len(c))).astype(int)]
    weight = n.astype(np.float32)[:, None]
    for left in range(rounds, -1, -1):
        half = np.einsum("ij,ij->i", centres, centres) / 2
        label = np.concatenate([(c[i : i + block] @ centres.T - half).argmax(axis=1) for i in range(0, len(c), block)])
        if left:
            order = np.argsort(label, kind="stable")
            starts = np.flatnonzero(np.diff(label[order], prepend=-1))
            centres = np.add.reduceat(c[order] * weight[order], starts) / np.add.reduceat(weight[order], starts)
    return label


def like_joined(ls: np.ndarray, n: np.ndarray, ss: np.ndarray, alike: float = 0.6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of features of unit vectors, those that hold like rows only join where they are alike; so a group of any size is one."""
    tight = np.linalg.norm(ls, axis=1) >= n * np.sqrt(1 - alike**2 / 2)
    tree = CFTree(ls.shape[1], alike, 1 << 62)
    tree.insert_rows(ls[tight], n[tight], ss[tight])
    joined = tree.entries()
    return np.concatenate([ls[~tight], joined[1]]), np.concatenate([n[~tight], joined[0]]), np.concatenate([ss[~tight], joined[2]])


def bulk_summary(vectors: DataFrame, dim: int, max_leaves: int, chunk: int = 65_536, fan_in: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``max_leaves`` entries (n, linear sums, square sums) over all rows of ``vectors`` (column v, unit vectors), by ``bulk``."""

    def frame(ls: np.ndarray, n: np.ndarray, ss: np.ndarray, part: int) -> pd.DataFrame:
        return summary_rows(n, ls, ss, 0, part)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        def held(parts: list) -> tuple:
            return bulk(*(np.concatenate(x) for x in zip(*parts)), max_leaves)

        done, rows = [], []
        for b in batches:
            if len(b):
                v = np.array(b["v"].tolist(), dtype=float)
                rows.append((v, np.ones(len(v)), np.einsum("ij,ij->i", v, v)))
                if sum(len(r[1]) for r in rows) >= chunk:
                    done, rows = [held([*done, held(rows)])], []
        if done or rows:
            yield frame(*held([*done, *([held(rows)] if rows else [])]), TaskContext.get().partitionId())

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "n", "ss"], kind="stable")
        return frame(*bulk(np.array(pdf["ls"].tolist(), dtype=float), pdf["n"].to_numpy(), pdf["ss"].to_numpy(), max_leaves), int(pdf["part"].iloc[0]) // fan_in)

    entries, parts = vectors.select("v").mapInPandas(build, SUMMARY), vectors.rdd.getNumPartitions()
    while parts > 1:
        entries = entries.groupBy((F.col("part") / F.lit(fan_in)).cast("int").alias("_g")).applyInPandas(merge, SUMMARY)
        parts = -(-parts // fan_in)
    n, ls, ss = ordered(entries.toPandas(), dim)
    ls, n, ss = like_joined(ls, n, ss)
    return n, ls, ss


def rows_of(tree: CFTree, cell: int, part: int) -> pd.DataFrame:
    """The leaf entries of a tree as rows of ``SUMMARY``."""
    return summary_rows(*tree.entries(), cell, part)


def summary_rows(n: np.ndarray, ls: np.ndarray, ss: np.ndarray, cell: int, part: int) -> pd.DataFrame:
    return pd.DataFrame({"cell": np.full(len(n), cell, np.int32), "part": np.full(len(n), part, np.int32), "n": n, "ls": list(ls), "ss": ss})


def reduced(entries: DataFrame, parts: int, dim: int, max_leaves: int, threshold: float = 0.0, fan_in: int = 4) -> DataFrame:
    """Summaries (``SUMMARY``) of each cell, merged to one: ``fan_in`` at a time by one task a round.

    ``parts`` is the most parts that a cell has. A merge inserts the entries of its summaries into one tree.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["part"].nunique() == 1:
            return pdf.assign(part=pdf["part"] // fan_in)
        tree = CFTree(dim, threshold, max_leaves)
        pdf = pdf.sort_values(["part", "n", "ss"], kind="stable")
        tree.insert_rows(np.array(pdf["ls"].tolist(), dtype=float), pdf["n"].to_numpy(), pdf["ss"].to_numpy())
        return rows_of(tree, int(pdf["cell"].iloc[0]), int(pdf["part"].iloc[0]) // fan_in)

    while parts > 1:
        entries = entries.groupBy("cell", (F.col("part") / F.lit(fan_in)).cast("int").alias("_g")).applyInPandas(merge, SUMMARY)
        parts = -(-parts // fan_in)
    return entries


def summary(vectors: DataFrame, dim: int, max_leaves: int, threshold: float = 0.0) -> DataFrame:
    """Leaf entries (``SUMMARY``) of one tree over all rows of ``vectors`` (column v): a tree for each partition, then merges."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tree = CFTree(dim, threshold, max_leaves)
        for b in batches:
            if len(b):
                tree.insert_rows(np.array(b["v"].tolist(), dtype=float))
        yield rows_of(tree, 0, TaskContext.get().partitionId())

    return reduced(vectors.select("v").mapInPandas(build, SUMMARY), vectors.rdd.getNumPartitions(), dim, max_leaves, threshold)


def summarise(vectors: DataFrame, dim: int, max_leaves: int, threshold: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``summary`` on the driver: at most ``max_leaves`` entries (n, linear sums, square sums), in order of their sums."""
    got = summary(vectors, dim, max_leaves, threshold).toPandas()
    return ordered(got, dim)


def ordered(entries: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ls = np.array(entries["ls"].tolist(), dtype=float).reshape(len(entries), dim)
    order = np.lexsort(ls.T[::-1])
    return entries["n"].to_numpy(dtype=float)[order], ls[order], entries["ss"].to_numpy(dtype=float)[order]
