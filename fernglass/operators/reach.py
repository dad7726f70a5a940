"""Everything that reaches each node of a graph, with its distance: breadth-first search from many targets at once.

Each target is one bit. A level is a bitwise or over the links, for all targets
of a batch together; the level at which a bit is first set goes, as a binary
number, into planes of bits, from which the rows are read when a batch is done.
A batch needs the links alone, so batches run apart from each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: 64-bit words of a batch's bits (8 MB), and words of one node at most.
WORDS, WIDEST = 1 << 20, 8
#: Links of a node that are taken one by one; those beyond are taken by node.
SLOTS = 16
#: Cells whose rows are read at once.
CELLS = 1 << 20


class Reach:
    """Links (src, dst) between nodes 0 to n - 1. Nodes are renumbered by their links: ``order`` has the old number of each."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int):
        links = np.bincount(src, minlength=n)
        self.n, self.order = n, np.argsort(-links, kind="stable")
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        links = links[self.order]
        by = np.argsort(place[src], kind="stable")
        src, dst = place[src][by], place[dst][by]
        start = np.cumsum(links) - links
        #: Nodes that have links come first; no other is ever found.
        self.callers = int((links > 0).sum())
        self.slots = [dst[start[: int((links > j).sum())] + j] for j in range(min(SLOTS, int(links.max(initial=0))))]
        many = int((links > SLOTS).sum())
        rest = np.arange(len(src)) - start[src] >= SLOTS
        self.rest, self.rest_from = dst[rest], np.cumsum(links[:many] - SLOTS) - (links[:many] - SLOTS)
        self.width = 1
        while self.width < WIDEST and 2 * self.width * n <= WORDS:
            self.width *= 2
        self.targets = self._together(np.unique(dst), src, dst)

    def _together(self, targets: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        """``targets`` in an order that puts those side by side that the same nodes reach: by the least of a random number over all that reach them."""
        least = np.random.default_rng(1).permutation(self.n)
        by = np.argsort(dst, kind="stable")
        src, first = src[by], np.searchsorted(dst[by], targets)
        while len(targets):
            new = np.minimum(least[targets], np.minimum.reduceat(least[src], first))
            if (new == least[targets]).all():
                break
            least[targets] = new
        return targets[np.argsort(least[targets], kind="stable")]

    def batches(self) -> int:
        return -(-len(self.targets) // (64 * self.width))

    def search(self, batch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(target, node, depth) of a batch, some at a time; a target is found itself if it lies on a cycle."""
        k, c = self.width, self.callers
        targets = self.targets[64 * k * batch : 64 * k * (batch + 1)]
        at, new, taken = np.zeros((self.n, k), np.uint64), np.zeros((self.n, k), np.uint64), np.empty((c, k), np.uint64)
        bit = np.arange(len(targets))
        at[targets, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
        unseen, planes, depth = np.full((c, k), ~np.uint64(0)), [], 0
        while True:
            depth += 1
            np.take(at, self.slots[0], axis=0, out=new[:c], mode="clip")
            for nodes in self.slots[1:]:
                m = len(nodes)
                np.take(at, nodes, axis=0, out=taken[:m], mode="clip")
                np.bitwise_or(new[:m], taken[:m], out=new[:m])
            if len(self.rest):
                new[: len(self.rest_from)] |= np.bitwise_or.reduceat(at[self.rest], self.rest_from, axis=0)
            found = new[:c]
            np.bitwise_and(found, unseen, out=found)
            if not found.any():
                break
            unseen ^= found
            if depth >> len(planes):
                planes.append(np.zeros((c, k), np.uint64))
            for b, plane in enumerate(planes):
                if depth >> b & 1:
                    plane |= found
            # what is found lies among the callers: beyond them, only the targets themselves were set
            at, new = new, at
            new[c:] = 0
        rows = np.flatnonzero((~unseen).any(1))
        for lo in range(0, len(rows), CELLS // (64 * k)):
            part = rows[lo : lo + CELLS // (64 * k)]
            level = np.zeros((len(part), 64 * k), np.int32)
            for b, plane in enumerate(planes):
                level |= np.unpackbits(plane[part].astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(np.int32) << b
            level = level.ravel()
            cell = np.flatnonzero(level)
            yield targets[cell % (64 * k)], part[cell // (64 * k)], level[cell]
