"""A signature tree over one block of token sets, and its dual traversal.

Leaves are sets; a node holds the OR of its leaves' bitmaps, their smallest and largest size and the
most tokens that share a bit with another token of the same set. For sets x below P and y below Q,

    |x & y| <= |bits(P) & bits(Q)| + collisions(P)      (and the same with Q's collisions),

so a pair of nodes goes when that, or the smaller sizes, can't reach the overlap that the threshold
asks for. Pairs whose sets are already in one component go too: only a spanning forest is wanted.
"""

from __future__ import annotations

import numpy as np

FAN = 8


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


class Block:
    """sets: sorted distinct uint64 tokens. side: pairs on one side are skipped; None: none are."""

    def __init__(self, sets: list[np.ndarray], percent: int, labels: list | None = None, side: list[int] | None = None):
        self.percent = percent
        self.order = sorted(range(len(sets)), key=lambda i: (sets[i][0], len(sets[i])))
        self.sets = [sets[i] for i in self.order]
        known = {v: i for i, v in enumerate(dict.fromkeys(labels))} if labels else {}
        self.label = np.array([known[labels[i]] for i in self.order]) if labels else np.arange(len(sets))
        self.side = [side[i] for i in self.order] if side else None
        self.edges: list[tuple[int, int]] = []

    def linked(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        p, (low, high) = self.percent, sorted((len(a), len(b)))
        if 100 * low < p * high:
            return False
        both = overlap(a, b)
        return 100 * both >= p * (len(a) + len(b) - both)

    def check(self, i: int, j: int) -> None:
        if self.label[i] == self.label[j] or self.side and self.side[i] == self.side[j]:
            return
        if self.linked(i, j):
            self.label[self.label == self.label[j]] = self.label[i]
            self.edges.append((self.order[i], self.order[j]))

    def forest(self) -> list[tuple[int, int]]:
        if len(self.sets) == 2:
            self.check(0, 1)
        elif len(self.sets) > 2:
            self._build()
            self._traverse()
        return self.edges

    def _build(self) -> None:
        sizes = np.array([len(s) for s in self.sets])
        bits = 1 << int(np.clip(4 * int(np.median(sizes)), 1024, 65536) - 1).bit_length()
        maps = np.zeros((len(sizes), bits // 8), np.uint8)
        for row, tokens in zip(maps, self.sets, strict=True):
            flags = np.zeros(bits, bool)
            flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
            row[:] = np.packbits(flags)
        maps = maps.view(np.uint64)
        lost = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, lost)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, lost = self.levels[-1]
            at = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at)))

    def _possible(self, level: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which of the node pairs can hold a link."""
        maps, low, high, lost = self.levels[level]
        shared = np.bitwise_count(maps[left] & maps[right]).sum(axis=1, dtype=np.int64)
        most = np.minimum(shared + np.minimum(lost[left], lost[right]), np.minimum(high[left], high[right]))
        p = self.percent
        ok = (100 + p) * most >= p * (low[left] + low[right])
        return ok & (100 * high[left] >= p * low[right]) & (100 * high[right] >= p * low[left])

    def _one(self, level: int, i: int, j: int) -> bool:
        width = FAN**level
        a, b = self.label[i * width : (i + 1) * width], self.label[j * width : (j + 1) * width]
        return a[0] == b[0] and (a == a[0]).all() and (b == a[0]).all()

    def _traverse(self) -> None:
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, i, j = todo.pop()
            if level == 0:
                self.check(i, j)
                continue
            if self._one(level, i, j):
                continue
            n = len(self.levels[level - 1][0])
            left, right = np.arange(i * FAN, min((i + 1) * FAN, n)), np.arange(j * FAN, min((j + 1) * FAN, n))
            x, y = np.repeat(left, len(right)), np.tile(right, len(left))
            if i == j:
                x, y = x[x < y], y[x < y]
            keep = self._possible(level - 1, x, y)
            todo += [(level - 1, a, b) for a, b in zip(x[keep][::-1].tolist(), y[keep][::-1].tolist(), strict=True)]
            if i == j and level > 1:  # each child's own pairs come first: what they link need not be compared again
                todo += [(level - 1, a, a) for a in left.tolist()]
