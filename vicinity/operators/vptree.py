"""Vantage-point trees: exact metric search, as a forest over the tasks' references.

References are cut into chunks by a hash; a task builds a tree over each chunk and searches it for the queries that it
meets there; the chunks' k best are merged like those of any other scan. The result is that of brute force, ties included: a subtree is passed
over only if it is strictly farther than the k-th distance, with an allowance for rounded roots.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from vicinity.operators.cells import MATRIX, all_pairs
from vicinity.operators.knn import K
from vicinity.operators.topk import first_of, smallest

#: Rows of a chunk that gets a tree of its own, and rows of a leaf that is scanned whole.
CHUNK, LEAF = 16384, 32
#: Rows of a subtree that many queries compare with at once.
WHOLE = 512


@dataclass
class VpTree:
    """Nodes in pre-order. ``point``: the vantage row; children are node numbers or -1; a leaf's rows are a slice of ``order``."""

    order: np.ndarray
    point: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: dict[int, tuple[int, int]]
    #: By how much, relatively, a threshold may be rounded: it is allowed for when subtrees are passed over.
    slack: float = 1e-12

    @property
    def size(self) -> int:
        return len(self.point)


def build(x: np.ndarray, leaf: int = LEAF) -> VpTree:
    """The first row of a slice is its vantage point; the others are split at the median distance, ties by row.

    With ``leaf`` = 1 every row is a node of its own.
    """
    order = np.arange(len(x))
    point, threshold, children, leaves = [], [], [], {}
    todo = [(0, len(x), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        if start >= end:
            continue
        node = len(point)
        if parent >= 0:
            children[parent][side] = node
        point.append(order[start])
        children.append([-1, -1])
        threshold.append(0.0)
        if end - start <= leaf:
            if end - start > 1:
                leaves[node] = start, end
            continue
        rest = order[start + 1 : end]
        gap = x[rest] - x[order[start]]
        d = (gap * gap).sum(axis=1)
        by = np.lexsort((rest, d))
        order[start + 1 : end] = rest[by]
        middle = start + 1 + (end - start - 1 >> 1)
        threshold[node] = float(np.sqrt(d[by][middle - start - 1]))
        todo.append((middle, end, node, 1))
        todo.append((start + 1, middle, node, 0))
    kids = np.array(children, np.int32).reshape(-1, 2)
    return VpTree(order, np.array(point, np.int64), np.array(threshold), kids[:, 0], kids[:, 1], leaves)


def search(tree: VpTree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, skip: int | None = None) -> list[tuple[float, int, int]]:
    """The k nearest rows of one query as (squared distance, id, row), nearest first, ties to the smaller id."""
    best: list[tuple[float, int, int]] = []

    def offer(rows: np.ndarray) -> np.ndarray:
        gap = x[rows] - q
        d = (gap * gap).sum(axis=1)
        near = np.flatnonzero(d <= best[-1][0]) if len(best) == k else range(len(rows))
        added = [(float(d[i]), int(ids[rows[i]]), int(rows[i])) for i in near if ids[rows[i]] != skip]
        if added:
            best[:] = sorted(best + added)[:k]
        return d

    todo = [(0, 0.0)] if tree.size else []
    while todo:
        node, least = todo.pop()
        if len(best) == k and least > np.sqrt(best[-1][0]) * (1 + 1e-12) + 1e-9:
            continue
        if node in tree.leaf:
            start, end = tree.leaf[node]
            offer(tree.order[start:end])
            continue
        d = float(np.sqrt(offer(tree.point[node : node + 1])[0]))
        left, right, t = int(tree.left[node]), int(tree.right[node]), float(tree.threshold[node])
        # inside: within t of the vantage point; outside: at t or beyond
        inside, outside = (left, max(0.0, d - t * (1 + tree.slack))), (right, max(0.0, t * (1 - tree.slack) - d))
        near, far = (inside, outside) if d < t else (outside, inside)
        todo += [(n, max(least, bound)) for n, bound in (far, near) if n >= 0]
    return best


def search_all(tree: VpTree, x: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, skip: np.ndarray | None = None, whole: int = WHOLE):
    """(query, row, squared distance) of the k nearest rows of each query, as ``search``; codes are whole numbers.

    Queries go down the tree together, those that are inside a vantage point's distance by the one side first and those
    outside by the other, and each leaves where ``search`` would. Subtrees of up to ``whole`` rows are compared at once.
    """
    n = len(queries)
    worst = np.full(n, np.inf)
    sizes = [0] * tree.size
    for node in range(tree.size - 1, -1, -1):  # children come after their parents
        start, end = tree.leaf.get(node, (0, 1))
        sizes[node] = end - start + sum(sizes[c] for c in (tree.left[node], tree.right[node]) if c >= 0)
    norms, own = (x * x).sum(axis=1), (queries * queries).sum(axis=1)
    near_d, near_row = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)

    def offer(some: np.ndarray, rows: np.ndarray) -> np.ndarray:
        d = own[some][:, None] + norms[rows] - 2 * (queries[some] @ x[rows].T)
        fit = d <= worst[some][:, None]
        if skip is not None:
            fit &= ids[rows] != skip[some][:, None]
        if np.isinf(worst[some]).any():
            r, c = smallest(np.where(fit, d, np.inf), ids[rows], k)
        else:
            r, c = np.nonzero(fit)
        if len(r):
            touched = np.unique(r)
            mine = some[touched]
            held, place = np.nonzero(near_row[mine] >= 0)
            row = np.r_[touched[held], r]
            column, far = np.r_[near_row[mine[held], place], rows[c]], np.r_[near_d[mine[held], place], d[r, c]]
            keep = first_of(row, far, ids[column], k)
            row, column, far = row[keep], column[keep], far[keep]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            near_d[some[row], place], near_row[some[row], place] = far, column
            worst[mine] = near_d[mine, k - 1]
        return d

    todo = [(0, 0, np.arange(n), np.zeros(n))] if tree.size else []
    while todo:
        node, start, some, least = todo.pop()
        stay = least <= np.sqrt(worst[some]) * (1 + 1e-12) + 1e-9
        some, least = some[stay], least[stay]
        if not len(some):
            continue
        if sizes[node] <= whole or node in tree.leaf:
            rows = tree.order[start : start + sizes[node]]
            step = max(1, MATRIX // len(rows))
            for i in range(0, len(some), step):
                offer(some[i : i + step], rows)
            continue
        d = np.sqrt(offer(some, tree.point[node : node + 1])[:, 0])
        left, right, t = int(tree.left[node]), int(tree.right[node]), float(tree.threshold[node])
        inside, outside = np.maximum(least, d - t * (1 + tree.slack)), np.maximum(least, t * (1 - tree.slack) - d)
        after = start + 1 + (sizes[left] if left >= 0 else 0)
        for first in (False, True):  # what is pushed last is visited first
            for child, begin, bound, by in ((left, start + 1, inside, (d < t) == first), (right, after, outside, (d < t) != first)):
                if child >= 0 and by.any():
                    todo.append((child, begin, some[by], bound[by]))
    row, place = np.nonzero(near_row >= 0)
    return row, near_row[row, place], near_d[row, place]


def forest(grow=build):
    """A maker of searches (see ``cells``) that grows a tree over a cell's references, and prunes it."""

    def maker(x: np.ndarray, ids: np.ndarray, k: int):
        tree = grow(x)

        def find(queries: np.ndarray, skip: np.ndarray | None):
            return search_all(tree, x, ids, queries, k, skip)

        return find

    return maker


def knn_vptree(refs: DataFrame, queries: DataFrame, k: int = K, skip_self: bool = False, chunk: int = CHUNK, grow=build) -> DataFrame:
    """(qid, rank, orig_id, label, dist), as ``knn.knn_brute``. ``grow`` makes the tree of a chunk's vectors."""
    return all_pairs(refs, queries, k, skip_self, forest(grow), chunk)
