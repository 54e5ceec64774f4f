"""Exact search within a cell: references and queries in blocks of neighbours, with the box that holds each block.

Equal references count by their k smallest ids, as no other can be among the k nearest; equal queries are searched once.
A block of queries meets the blocks of references in the order of the distances of their boxes, until no box that is left
can hold a row as near as the k-th of any of its queries; ties count. So the result is that of a scan.
"""

from __future__ import annotations

import numpy as np

from vicinity.operators.topk import first_of, smallest

#: References and queries of a block, and blocks of references that a block of queries meets at first.
LEAF, TEAM, FIRST = 64, 128, 4


def groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): rows sorted so that equal ones stand together, and in their order; group numbers in that order.

    Sorted by a hash. Of rows that differ under one hash, equal ones may get several groups.
    """
    factors = np.random.default_rng(1).integers(1 << 62, 1 << 63, x.shape[1], dtype=np.uint64) | np.uint64(1)
    hashed = (x.astype(np.int64).view(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
    order = np.argsort(hashed, kind="stable")
    fresh = np.any(x[order[1:]] != x[order[:-1]], axis=1)
    return order, np.cumsum(np.r_[0, fresh][: len(x)])


def split(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in blocks of at most ``most``, each half of a block cut at the median of its longest side."""
    done, todo = [], [np.arange(len(x))] if len(x) else []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        part = x[rows]
        side = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        half = len(rows) // 2
        by = np.argpartition(part[:, side], half)
        todo += [rows[by[half:]], rows[by[:half]]]
    return done


def boxed(refs: np.ndarray, ids: np.ndarray, k: int):
    """A search as ``cells.scan``; ``within`` leaves out what is farther than a bound of each query."""
    more = k + 1  # one of them may be the one that is left out
    by_id = np.argsort(ids, kind="stable")
    order, group = groups(refs[by_id])
    order = by_id[order]
    order = order[np.arange(len(order)) - np.searchsorted(group, group) < more]
    blocks = split(refs[order], LEAF)
    rows = order[np.concatenate(blocks)]
    ends = np.cumsum([len(b) for b in blocks])
    starts = ends - [len(b) for b in blocks]
    x, names = np.ascontiguousarray(refs[rows]), ids[rows]
    norms = (x * x).sum(axis=1)
    low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)

    def meet(q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gap = np.maximum(low - q.max(axis=0), q.min(axis=0) - high)
        np.maximum(gap, 0, out=gap)
        least = (gap * gap).sum(axis=1)
        todo = np.argsort(least, kind="stable")
        own, count = (q * q).sum(axis=1)[:, None], FIRST
        row, column, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        limit = limit.copy()
        while True:
            todo = todo[: np.searchsorted(least[todo], limit.max(), "right")]
            if not len(todo):
                return row, column, d
            at = np.concatenate([np.arange(starts[b], ends[b]) for b in todo[:count]])
            todo, count = todo[count:], min(2 * count, 64)
            far = own + norms[at] - 2 * (q @ x[at].T)
            if np.isinf(limit).any():
                r, c = smallest(np.where(far <= limit[:, None], far, np.inf), names[at], more)
            else:
                r, c = np.nonzero(far <= limit[:, None])
            row, column, d = np.r_[row, r], np.r_[column, at[c]], np.r_[d, far[r, c]]
            keep = first_of(row, d, names[column], more)
            row, column, d = row[keep], column[keep], d[keep]
            last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == more - 1)
            limit[row[last]] = d[last]

    def search(queries: np.ndarray, skip: np.ndarray | None, within: np.ndarray | None = None):
        order, group = groups(queries)
        begins = np.flatnonzero(np.r_[1, np.diff(group)])[: len(order)]
        some = queries[order[begins]]
        limit = np.full(len(some), np.inf) if within is None else np.maximum.reduceat(within[order], begins)
        found = [(block, *meet(some[block], limit[block])) for block in split(some, TEAM)]
        row, column, d = (np.concatenate(parts) for parts in zip(*((block[r], c, far) for block, r, c, far in found)))
        # of each distinct query, in its order; then of each query
        by = np.argsort(row, kind="stable")
        row, column, d = row[by], column[by], d[by]
        bounds = np.searchsorted(row, np.arange(len(some) + 1))
        n = np.diff(bounds)[group]
        asked = np.repeat(order, n)
        at = np.repeat(bounds[group], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        column, d = column[at], d[at]
        keep = np.ones(len(asked), bool)
        if skip is not None:
            keep &= names[column] != skip[asked]
        if within is not None:
            keep &= d <= within[asked]
        asked, column, d = asked[keep], column[keep], d[keep]
        first = np.r_[True, asked[1:] != asked[:-1]][: len(asked)]
        keep = np.arange(len(asked)) - np.flatnonzero(first)[np.cumsum(first) - 1] < k
        return asked[keep], rows[column[keep]], d[keep]

    return search
