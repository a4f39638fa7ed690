"""Hamming self-join of 64-bit fingerprints by a hierarchical index in Gray order.

Fingerprints are sorted by Gray rank within their buckets, so that neighbours differ in few bits. Runs of
neighbours form nodes, runs of nodes form nodes above; a node keeps the bits all its members share (a
mask and their pattern). Two nodes are compared on the bits both masks have; what a parent pair has
compared is not compared again: its differences are carried down and the child adds those of the bits
that are new to it. A pair of nodes with more than ``radius`` differences is dropped with all below it; a
pair that can't exceed the radius whatever the open bits are is linked as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 16


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the sequence of reflected Gray codes."""
    rank = codes.astype(np.uint64, copy=True)
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """buckets: any integers; only members of one bucket are compared."""

    def __init__(self, codes: np.ndarray, buckets: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), buckets))
        codes, buckets = codes[self.order].astype(np.uint64), buckets[self.order]
        full = np.full(len(codes), ~np.uint64(0))
        #: by level, the members themselves first: pattern, mask, first child (and the end), bucket
        self.levels = [(codes, full, None, buckets)]
        while len(codes):
            lower, (pattern, mask, _, of) = len(self.levels[-1][0]), self.levels[-1]
            new = np.concatenate([[True], of[1:] != of[:-1]])
            begin = np.flatnonzero(new)
            place = np.arange(lower) - np.repeat(begin, np.diff(np.append(begin, lower)))
            first = np.flatnonzero(place % FAN == 0)
            all_set = np.bitwise_and.reduceat(pattern & mask, first)
            none_set = np.bitwise_and.reduceat(~pattern & mask, first)
            self.levels.append((all_set, all_set | none_set, np.append(first, lower), of[first]))
            if len(first) == len(begin):
                break

    def spans(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end position of the members below nodes."""
        low, high = nodes, nodes + 1
        for k in range(level, 0, -1):
            starts = self.levels[k][2]
            low, high = starts[low], starts[high]
        return low, high

    def links(self, radius: int, step: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays (i, j) of positions in the input whose codes differ in ``radius`` bits or fewer. Of node
        pairs linked as a whole only enough links are given to connect all their members."""
        top = len(self.levels) - 1
        if top < 1:
            return
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots, np.zeros(len(roots), np.int64))]
        while stack:
            level, a, b, differences = stack.pop()
            if len(a) > step:
                stack.append((level, a[step:], b[step:], differences[step:]))
                a, b, differences = a[:step], b[:step], differences[:step]
            _, mask, starts, _ = self.levels[level]
            compared = mask[a] & mask[b]
            na, nb = starts[a + 1] - starts[a], starts[b + 1] - starts[b]
            each = na * nb
            pair = np.repeat(np.arange(len(a)), each)
            within = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
            ca, cb = starts[a][pair] + within // nb[pair], starts[b][pair] + within % nb[pair]
            upper = ca <= cb if level > 1 else ca < cb
            pair, ca, cb = pair[upper], ca[upper], cb[upper]
            pattern, mask, _, _ = self.levels[level - 1]
            both = mask[ca] & mask[cb]
            total = differences[pair] + np.bitwise_count((pattern[ca] ^ pattern[cb]) & both & ~compared[pair])
            near = total <= radius
            ca, cb, total, both = ca[near], cb[near], total[near], both[near]
            if level == 1:
                yield self.order[ca], self.order[cb]
                continue
            whole = total + np.bitwise_count(~both) <= radius
            if whole.any():
                yield self._whole(level - 1, ca[whole], cb[whole])
                ca, cb, total = ca[~whole], cb[~whole], total[~whole]
            if len(ca):
                stack.append((level - 1, ca, cb, total))

    def _whole(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (a0, a1), (b0, b1) = self.spans(level, a), self.spans(level, b)
        left, right = [], []
        for heads, low, high in ((b0, a0, a1), (a0, b0, b1)):
            n = high - low
            left.append(np.repeat(heads, n))
            right.append(np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        i, j = np.concatenate(left), np.concatenate(right)
        return self.order[i[i != j]], self.order[j[i != j]]


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest, of links among those given, of 0..n-1."""
    parent = np.arange(n)
    out: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        # most links of a dense group are settled by comparing roots in bulk
        while len(a):
            top_a, top_b = parent[a], parent[b]
            while (parent[top_a] != top_a).any() or (parent[top_b] != top_b).any():
                top_a, top_b = parent[top_a], parent[top_b]
            parent[a], parent[b] = top_a, top_b
            open_ = top_a != top_b
            a, b, top_a, top_b = a[open_], b[open_], top_a[open_], top_b[open_]
            if not len(a):
                break
            key = np.maximum(top_a, top_b)
            _, first = np.unique(key, return_index=True)
            for i in first.tolist():
                x, y = root(int(a[i])), root(int(b[i]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(a[i]), int(b[i])))
    return out
