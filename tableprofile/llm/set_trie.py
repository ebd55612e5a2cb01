"""A trie of ordered sets, and the search for similar sets in it."""

from __future__ import annotations

import numpy as np

CHUNK = 32  # tokens of a leaf that are looked at together with those of its siblings


class _Node:
    """Sets ``lo`` to ``hi`` share their tokens up to ``end``; the edge into it begins at ``start``."""

    __slots__ = ("start", "end", "lo", "hi", "kids", "leaves", "heads", "last", "ends_here", "shortest", "longest")

    def __init__(self, start: int, end: int, lo: int, hi: int):
        self.start, self.end, self.lo, self.hi = start, end, lo, hi
        self.kids: list[_Node] = []
        self.leaves: list[int] = []  # sets that go on alone
        self.ends_here: list[int] = []


class SetTrie:
    """Sets of tokens in one order, rare tokens first, by their common beginnings.

    Links are searched for connectivity: sets of one label are linked already, and a subtree
    whose sets all have the label of the set that is looked for is skipped.
    """

    def __init__(self, sets: list[np.ndarray], labels: list[int], probes: list[bool], percent: int):
        tokens, places, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(tokens), np.int32)
        rank[np.lexsort((tokens, counts))] = np.arange(len(tokens), dtype=np.int32)
        ranked = [np.sort(part) for part in np.split(rank[places], np.cumsum([len(s) for s in sets])[:-1])]
        order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">i4").tobytes())
        self.sets, self.percent = [ranked[i] for i in order], percent
        self.sizes = np.array([len(s) for s in self.sets])
        self.labels, self.probes = np.array(labels, np.int64)[order], np.array(probes)[order]
        self._inside = np.zeros(len(tokens) + 1, bool)  # the last is no token
        self._root = self._build()

    def _build(self) -> _Node:
        shared = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            at = int(differ.argmax()) if n else 0
            shared.append(at if n and differ[at] else n)
        shared, sizes = np.array(shared), self.sizes
        root = _Node(0, 0, 0, len(self.sets))
        todo = [root]
        while todo:
            node = todo.pop()
            lo, hi = node.lo, node.hi
            if node is not root:
                node.end = int(shared[lo + 1 : hi].min())
            node.shortest, node.longest = int(sizes[lo:hi].min()), int(sizes[lo:hi].max())
            at = lo
            while at < hi and sizes[at] == node.end:
                node.ends_here.append(at)
                at += 1
            cuts = [at, *(at + 1 + np.flatnonzero(shared[at + 1 : hi] == node.end)).tolist(), hi] if at < hi else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a == 1:
                    node.leaves.append(a)
                else:
                    node.kids.append(_Node(node.end, node.end, a, b))
            todo += node.kids
            heads = np.full((len(node.leaves), CHUNK), len(self._inside) - 1, np.int32)
            for row, leaf in zip(heads, node.leaves, strict=True):
                part = self.sets[leaf][node.end : node.end + CHUNK]
                row[: len(part)] = part
            node.heads, node.leaves = heads, np.array(node.leaves, np.intp)
            ends = np.minimum(node.end + CHUNK, sizes[node.leaves]) - 1
            node.last = np.array([self.sets[leaf][e] for leaf, e in zip(node.leaves, ends, strict=True)], np.int32)
        return root

    def _needed(self, n: int, m: np.ndarray | int) -> np.ndarray | int:
        """The smallest intersection at which sets of ``n`` and ``m`` tokens are linked."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def _join(self, a: int, b: int) -> None:
        low, high = sorted((self.labels[a], self.labels[b]))
        self.labels[self.labels == high] = low

    def _wanted(self, probe: int, others: np.ndarray) -> np.ndarray:
        """Sets with another label; of two probes, the first looks at the second."""
        return (self.labels[others] != self.labels[probe]) & ((others > probe) | ~self.probes[others])

    def look(self, probe: int) -> None:
        """Join the labels of all sets that set ``probe`` is linked to."""
        x, inside = self.sets[probe], self._inside
        n = len(x)
        inside[x] = True
        shortest, longest = -(-self.percent * n // 100), 100 * n // self.percent
        todo = [(self._root, 0, 0)]
        while todo:
            node, at, overlap = todo.pop()
            if node.shortest > longest or node.longest < shortest:
                continue
            if not self._wanted(probe, np.arange(node.lo, node.hi)).any():
                continue
            edge = self.sets[node.lo][node.start : node.end]
            if len(edge):  # its share of the overlap holds for all sets below
                overlap += int(inside[edge].sum())
                at = int(x.searchsorted(edge[-1], "right"))
            # What is left of the probe and of the longest set below can all be shared at best.
            if overlap + min(n - at, node.longest - node.end) < self._needed(n, max(node.shortest, shortest)):
                continue
            for other in node.ends_here:
                if overlap >= self._needed(n, len(self.sets[other])) and self._wanted(probe, np.array([other]))[0]:
                    self._join(probe, other)
            if len(node.leaves):
                self._look_at_leaves(probe, node, overlap, shortest, longest)
            todo += [(kid, at, overlap) for kid in node.kids]
        inside[x] = False

    def _look_at_leaves(self, probe: int, node: _Node, overlap: int, shortest: int, longest: int) -> None:
        """The same bounds for all sets that leave a node alone, by the next tokens of each."""
        x, inside, leaves = self.sets[probe], self._inside, node.leaves
        n, sizes = len(x), self.sizes[leaves]
        open_to = self._wanted(probe, leaves) & (sizes >= shortest) & (sizes <= longest)
        if not open_to.any():
            return
        rows = np.flatnonzero(open_to)
        overlaps = overlap + inside[node.heads[rows]].sum(1)
        left = np.minimum(n - x.searchsorted(node.last[rows], "right"), np.maximum(0, sizes[rows] - node.end - CHUNK))
        needed = self._needed(n, sizes[rows])
        for row in np.flatnonzero(overlaps + left >= needed).tolist():
            leaf = int(leaves[rows[row]])
            if self.labels[leaf] == self.labels[probe]:
                continue
            whole = int(overlaps[row]) + int(inside[self.sets[leaf][node.end + CHUNK :]].sum())
            if whole >= needed[row]:
                self._join(probe, leaf)


def similar(sets: list[np.ndarray], labels: list[int], probes: list[bool], percent: int) -> dict[int, int]:
    """For each label that links join with a smaller one, the smallest label it is joined with.

    Two sets, neither of them empty, are linked if 100 * intersection >= ``percent`` * union;
    pairs without a probe are not looked at.
    """
    if len(sets) < 2:
        return {}
    trie = SetTrie(sets, labels, probes, percent)
    before = trie.labels.copy()
    for at in np.flatnonzero(trie.probes).tolist():
        trie.look(at)
    return {int(a): int(b) for a, b in zip(before, trie.labels, strict=True) if a != b}
