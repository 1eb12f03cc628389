"""Signature tree over token sets, and the dual traversal that joins two of them.

A node stands for a run of sets and holds the range of their sizes and an OR-combined token bitmap: a cell per hash value
with the largest number of tokens that one of its sets has there (a bit is set where that number is above zero). Two sets
under nodes P and Q share at most the sum of the cell-wise smaller numbers, so a pair of nodes whose bound is below what
the threshold needs is pruned with everything under it. So are pairs that are already in one component, as only the
components are wanted. What is left is compared exactly.
"""

from __future__ import annotations

import numpy as np

CELLS = 512
#: Node pairs whose bounds are computed at once.
AT_ONCE = 2048


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets; an empty set is linked with nothing."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)) or not len(a) or not len(b):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class Tree:
    """Levels of nodes over sets in the given order; level 0 has the sets themselves."""

    def __init__(self, sets: list[np.ndarray]):
        cells = np.zeros((len(sets), CELLS), "u2")
        for i, one in enumerate(sets):
            cells[i] = np.minimum(np.bincount((one >> np.uint64(20)).astype("i8") % CELLS, minlength=CELLS), 65535)
        size = np.fromiter(map(len, sets), "i8", len(sets))
        self.cells, self.least, self.most = [cells], [size], [size]
        while len(self.cells[-1]) > 1:
            at = np.arange(0, len(self.cells[-1]), 2)
            self.cells.append(np.maximum.reduceat(self.cells[-1], at))
            self.least.append(np.minimum.reduceat(self.least[-1], at))
            self.most.append(np.maximum.reduceat(self.most[-1], at))

    def labels(self, label: np.ndarray) -> list[np.ndarray]:
        """Per level, the label all sets under a node share, or -1."""
        out = [label]
        for cells in self.cells[1:]:
            below = out[-1]
            at = np.arange(0, len(below), 2)
            low, high = np.minimum.reduceat(below, at), np.maximum.reduceat(below, at)
            out.append(np.where((low == high) & (low >= 0), low, -1))
        return out


def _kept(one: Tree, two: Tree, level: int, p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    keep = np.zeros(len(p), bool)
    a, b = one.least[level][p], two.least[level][q]
    near = np.flatnonzero((one.most[level][p] * 100 >= percent * b) & (two.most[level][q] * 100 >= percent * a))
    for at in range(0, len(near), AT_ONCE):
        i = near[at : at + AT_ONCE]
        shared = np.minimum(one.cells[level][p[i]], two.cells[level][q[i]]).sum(axis=1, dtype="i8")
        keep[i] = shared * (100 + percent) >= percent * (a[i] + b[i])
    return keep


def join(sets: list[np.ndarray], percent: int, split: int | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked: pairs of places in `sets`.

    With `split`, only pairs of one set before and one set from that place on count. Sets with equal `label` (0 or more)
    are known to be connected. Every returned pair is a link, and any two linked sets are connected by the labels and
    the returned pairs.
    """
    n = len(sets)
    union, found = Union(n), []
    if label is not None:
        first: dict[int, int] = {}
        for i, x in enumerate(label.tolist()):
            if x >= 0:
                union.join(first.setdefault(x, i), i)

    def check(i: int, j: int) -> None:
        if union.find(i) != union.find(j) and linked(sets[i], sets[j], percent):
            union.join(i, j)
            found.append((i, j))

    def order(places) -> list[int]:
        return sorted(places, key=lambda i: (len(sets[i]), sets[i][:4].tolist()))

    left = order(range(n if split is None else split))
    right = left if split is None else order(range(split, n))
    if n <= 8 and split is None:
        for i in range(n):
            for j in range(i + 1, n):
                check(i, j)
        return found
    if split is None:
        for i, j in zip(left, left[1:]):
            check(i, j)
    middle = left[len(left) // 2]
    for j in right:
        if j != middle:
            check(middle, j)

    one = Tree([sets[i] for i in left])
    two = one if split is None else Tree([sets[i] for i in right])
    roots = np.array([union.find(i) for i in range(n)])
    marks_one = one.labels(roots[left])
    marks_two = marks_one if split is None else two.labels(roots[right])
    top_one, top_two = len(one.cells) - 1, len(two.cells) - 1
    level = min(top_one, top_two)
    p, q = (x.ravel() for x in np.meshgrid(np.arange(len(one.cells[level])), np.arange(len(two.cells[level])), indexing="ij"))
    while True:
        keep = (marks_one[level][p] < 0) | (marks_one[level][p] != marks_two[level][q])
        if split is None:
            keep &= p <= q
        p, q = p[keep], q[keep]
        keep = _kept(one, two, level, p, q, percent)
        p, q = p[keep], q[keep]
        if not level:
            break
        level -= 1
        a, b = len(one.cells[level]), len(two.cells[level])
        p, q = np.repeat(p * 2, 4) + np.tile([0, 0, 1, 1], len(p)), np.repeat(q * 2, 4) + np.tile([0, 1, 0, 1], len(q))
        inside = (p < a) & (q < b)
        p, q = p[inside], q[inside]
    for i, j in zip(p.tolist(), q.tolist()):
        if left[i] != right[j]:
            check(left[i], right[j])
    return found
