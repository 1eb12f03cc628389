"""Deep-shallow sorting of suffixes, and the windows that sorted suffixes share.

Suffixes that start with the same gram come as one group, each with the bytes around its anchor. They are sorted to the
right and (reversed) to the left of the anchor. Sorting is multikey quicksort on eight-byte words to a shallow depth, for
all groups at once; suffixes that still agree then go into a blind trie per group, which orders long common prefixes with
one full comparison per suffix.
"""

from __future__ import annotations

import numpy as np

#: Eight-byte words that the multikey quicksort looks at.
SHALLOW = 6


class BlindTrie:
    """Orders strings of equal length. Inner nodes hold the place of the first difference and a child per byte there."""

    def __init__(self, strings: np.ndarray):
        self.strings = strings
        self.root: list | None = None  # [place, {byte: node}] or a leaf [None, places of equal strings]

    def insert(self, i: int) -> None:
        own = self.strings[i]
        if self.root is None:
            self.root = [None, [i]]
            return
        node = self.root
        while node[0] is not None:  # blindly down to any leaf that may agree
            below = node[1].get(int(own[node[0]]))
            node = below if below is not None else next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        differ = own != other
        place = int(differ.argmax())
        if not differ[place]:
            node[1].append(i)
            return
        byte, above, node = None, None, self.root
        while node[0] is not None and node[0] < place:
            above, byte = node, int(own[node[0]])
            node = node[1][byte]
        leaf = [None, [i]]
        if node[0] == place:
            node[1][int(own[place])] = leaf
            return
        fork = [place, {int(other[place]): node, int(own[place]): leaf}]
        if above is None:
            self.root = fork
        else:
            above[1][byte] = fork

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            place, below = stack.pop()
            if place is None:
                out.extend(below)
            else:
                stack.extend(below[b] for b in sorted(below, reverse=True))
        return out


def deep_shallow(strings: np.ndarray, group: np.ndarray, skip: int = 0, shallow: int = SHALLOW) -> np.ndarray:
    """Order of the rows of `strings` (n, a multiple of 8 bytes) by group, then by content.

    `group` is ascending. The first `skip` bytes are known to be equal within a group.
    """
    n, width = strings.shape
    words = np.ascontiguousarray(strings).view(">u8").astype("u8").reshape(n, width // 8)
    order, cls = np.arange(n), group.astype("i8")
    for depth in range(skip // 8, min(width // 8, skip // 8 + shallow)):
        change = np.concatenate(([True], cls[1:] != cls[:-1]))
        first = np.flatnonzero(change)
        size = np.diff(np.append(first, n))
        open_ = np.repeat(size > 1, size)
        at = np.flatnonzero(open_)
        if not len(at):
            return order
        word = words[order[at], depth]
        sort = np.lexsort((word, cls[at]))
        order[at] = order[at[sort]]
        # Class numbers grow along the order: old ones are spread out, then every new word starts a class.
        fresh = np.zeros(n, bool)
        fresh[first] = True
        word = word[sort]
        fresh[at[1:]] |= word[1:] != word[:-1]
        cls = np.cumsum(fresh)
    first = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
    for start, stop in zip(first.tolist(), np.append(first[1:], n).tolist()):
        if stop - start > 1:
            members = order[start:stop]
            trie = BlindTrie(strings[members])
            for i in range(len(members)):
                trie.insert(i)
            order[start:stop] = members[trie.ordered()]
    return order


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix per row; zero bytes stand for what lies outside of a text and agree with nothing."""
    differ = (a != b) | (a == 0)
    first = differ.argmax(1)
    return np.where(differ[np.arange(len(a)), first], first, a.shape[1])


def shared_windows(right: np.ndarray, left: np.ndarray, window: int, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, least and most: windows that start `least` to `most` bytes before the anchor of the row occur in another row.

    Rows are one group. For a depth a on the left, the rows that agree on a bytes there are a subtree of the left trie; a
    row's longest match to the right among them is that of a neighbour in right order. So each subtree settles the depths
    between its parent's and its own for all its rows at once.
    """
    n = len(right)
    none = np.zeros(n, "i8")
    order_right, order_left = deep_shallow(right, none, skip), deep_shallow(left, none)
    lcp_right = np.concatenate(([0], common(right[order_right[1:]], right[order_right[:-1]])))
    lcp_left = np.concatenate(([0], common(left[order_left[1:]], left[order_left[:-1]])))
    if lcp_right.max() + lcp_left.max() < window:
        return none[:0], none[:0], none[:0]
    rank = np.empty(n, "i8")
    rank[order_right] = np.arange(n)
    found = [(none[:0], none[:0], 0)]
    stack = [(0, n, -1)]
    while stack:
        lo, hi, above = stack.pop()
        inner = lcp_left[lo + 1 : hi]
        depth = int(inner.min())
        ranks = np.sort(rank[order_left[lo:hi]])
        # Least common prefix between neighbours: up to, and then with, the last step.
        bounds = np.stack((ranks[:-1] + 1, np.minimum(ranks[1:] + 1, n - 1)), 1).ravel()
        gaps = np.minimum(np.minimum.reduceat(lcp_right, bounds)[::2], lcp_right[ranks[1:]])
        best = np.maximum(np.append(0, gaps), np.append(gaps, 0))
        if best.max() + int(inner.max()) < window:
            continue
        least = np.maximum(above + 1, window - best)
        hit = np.flatnonzero(least <= depth)
        if len(hit):
            found.append((order_right[ranks[hit]], least[hit], depth))
        cuts = [lo, *(np.flatnonzero(inner == depth) + lo + 1).tolist(), hi]
        stack.extend((a, b, depth) for a, b in zip(cuts, cuts[1:]) if b - a > 1)
    rows, least, most = zip(*found)
    return np.concatenate(rows), np.concatenate(least), np.repeat(most, [len(r) for r in rows])
