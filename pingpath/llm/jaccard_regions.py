"""Exact Jaccard join of one region: pivots, Voronoi cells, triangle windows.

Pure numpy over the shingle sets of one region; ``ngram_join`` makes the regions.
"""

from __future__ import annotations

import numpy as np

#: Members joined directly.
LEAF = 96
_PIVOTS = 8
_COLUMNS = 4096


class Members:
    """Sets of one region: sorted distinct shingles, end to end, and who owns them."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.items = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def of(self, i: int) -> np.ndarray:
        return self.items[self.first[i]:self.first[i + 1]]

    def common(self, pivots: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Shingles that each row has in common with each pivot set."""
        pick = np.concatenate([np.arange(self.first[i], self.first[i + 1]) for i in rows])
        items, owner = self.items[pick], np.repeat(np.arange(len(rows)), self.size[rows])
        out = np.empty((len(rows), len(pivots)), dtype=np.int64)
        for k, p in enumerate(pivots):
            at = np.minimum(np.searchsorted(p, items), len(p) - 1)
            out[:, k] = np.bincount(owner[p[at] == items], minlength=len(rows))
        return out

    def distances(self, pivots: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Jaccard distance of each row to each pivot set."""
        common = self.common(pivots, rows)
        return 1 - common / (self.size[rows][:, None] + np.array([len(p) for p in pivots]) - common)


def cells(distance: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row, and the cells whose window holds it.

    If d(x, y) <= eps, x is in the cell of p and d(x, p) <= d(x, q) for all q, then
    d(y, p) <= d(x, p) + eps <= d(x, q) + eps <= d(y, q) + 2 eps: y lies in the
    window of p, the rows within 2 eps of their own nearest distance.
    """
    nearest = distance.argmin(axis=1)
    return nearest, distance <= distance.min(axis=1)[:, None] + 2 * eps + 1e-12


def _pairs_direct(m: Members, rows: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among ``rows``, by counting common shingles in blocks of columns."""
    if len(rows) == 2:
        a, b = m.of(rows[0]), m.of(rows[1])
        both = np.sort(np.concatenate([a, b]))
        common = int((both[1:] == both[:-1]).sum())
        linked = den * common >= num * (len(a) + len(b) - common)
        return (rows[:1], rows[1:]) if linked else (rows[:0], rows[:0])
    pick = np.concatenate([np.arange(m.first[i], m.first[i + 1]) for i in rows])
    owner = np.repeat(np.arange(len(rows)), m.size[rows])
    order = np.argsort(m.items[pick], kind="stable")
    items, owner = m.items[pick][order], owner[order]
    new = np.concatenate([[True], items[1:] != items[:-1]])
    code = np.cumsum(new) - 1
    shared = np.bincount(code) > 1  # what one set has alone is in no intersection
    keep = shared[code]
    column = (np.cumsum(shared) - 1)[code[keep]]
    owner = owner[keep]
    common = np.zeros((len(rows), len(rows)))
    at = 0
    while at < len(column):  # columns come in order
        to = int(np.searchsorted(column, column[at] + _COLUMNS))
        grid = np.zeros((len(rows), _COLUMNS), dtype=np.float32)
        grid[owner[at:to], column[at:to] - column[at]] = 1
        common += grid @ grid.T
        at = to
    size = m.size[rows]
    linked = den * common >= num * (size[:, None] + size[None, :] - common)
    i, j = np.nonzero(np.triu(linked, 1))
    return rows[i], rows[j]


def _pairs_blocks(m: Members, rows: np.ndarray, num: int, den: int):
    """Blocks of members by size against blocks whose sizes a link allows."""
    rows = rows[np.argsort(m.size[rows], kind="stable")]
    blocks = [rows[i:i + LEAF] for i in range(0, len(rows), LEAF)]
    for i, a in enumerate(blocks):
        yield _pairs_direct(m, a, num, den) if len(a) > 1 else (a[:0], a[:0])
        for b in blocks[i + 1:]:
            if den * m.size[a[-1]] < num * m.size[b[0]]:
                break
            x, y = _pairs_direct(m, np.concatenate([a, b]), num, den)
            across = np.isin(x, a) != np.isin(y, a)
            yield x[across], y[across]


def linked_pairs(m: Members, num: int, den: int, rows: np.ndarray | None = None,
                 own: np.ndarray | None = None):
    """Yield arrays (x, y) of linked pairs, each pair exactly once.

    ``own`` marks rows whose cell this is; the others are here for the window.
    A pair counts in the cell of its lower row.
    """
    rows = np.arange(len(m.size)) if rows is None else rows
    own = np.ones(len(rows), dtype=bool) if own is None else own
    if len(rows) < 2:
        return
    eps = 1 - num / den

    def mine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.minimum(x, y), np.maximum(x, y)
        at = np.searchsorted(rows, low)
        keep = own[at]
        return low[keep], high[keep]

    if len(rows) <= LEAF:
        yield mine(*_pairs_direct(m, rows, num, den))
        return
    pivots = [0]
    distance = m.distances([m.of(rows[0])], rows)
    while len(pivots) < _PIVOTS:  # each next pivot is the member farthest from all before
        far = int(distance.min(axis=1).argmax())
        if distance[far].min() == 0:
            break
        pivots.append(far)
        distance = np.hstack([distance, m.distances([m.of(rows[far])], rows)])
    nearest, window = cells(distance, eps)
    if window.sum() > 2.5 * len(rows) or window.sum(axis=0).max() > 0.9 * len(rows):
        for x, y in _pairs_blocks(m, rows, num, den):  # the windows hold nearly everything
            yield mine(x, y)
        return
    for k in range(len(pivots)):
        inside = window[:, k]
        yield from linked_pairs(m, num, den, rows[inside], own[inside] & (nearest[inside] == k))


def components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least row of each row's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
