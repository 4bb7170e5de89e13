"""An R-tree over vectors of counts, searched for points whose sets may overlap enough.

A set's tokens are hashed into groups; the point of the set has the number of its tokens in each
group. Two sets have at most the sum of the coordinate minima in common, so a node's box (its
highest count in each group, its lowest and highest set size) bounds the overlap of a query with
everything below the node.
"""

from __future__ import annotations

import numpy as np

#: Children of a node.
FAN = 16
#: Bounds computed at a time.
CHUNK = 1 << 15


def enough(overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b with this overlap have a Jaccard similarity of 0.8 or more."""
    return 100 * overlap >= 80 * (a + b - overlap)


class Tree:
    """Points (rows of counts) with the sizes of their sets."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # Sort-tile-recursive packing: slabs of like size, within them by the widest coordinate.
        n = len(points)
        order = np.argsort(sizes, kind="stable")
        slab = max(FAN, int(np.ceil(np.sqrt(n / FAN))) * FAN)
        if n > FAN:
            for at in range(0, n, slab):
                part = order[at : at + slab]
                widest = int(np.argmax(points[part].max(0) - points[part].min(0)))
                order[at : at + slab] = part[np.argsort(points[part, widest], kind="stable")]
        self.order = order
        high, low, top = points[order], sizes[order], sizes[order]
        #: From the points up to the root: highest counts, lowest and highest size of each node.
        self.levels = [(high, low, top)]
        while len(high) > 1:
            cuts = np.arange(0, len(high), FAN)
            high, low, top = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(top, cuts)
            self.levels.append((high, low, top))

    def search(self, queries: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) that the bound leaves."""
        query = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low, top = self.levels[depth]
            if depth < len(self.levels) - 1:
                query = np.repeat(query, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = node < len(high)
                query, node = query[real], node[real]
            # A set of size a can reach the similarity with sizes from 0.8 a to a / 0.8.
            fits = (5 * top[node] >= 4 * sizes[query]) & (4 * low[node] <= 5 * sizes[query])
            query, node = query[fits], node[fits]
            keep = np.zeros(len(query), bool)
            for at in range(0, len(query), CHUNK):
                q, k = query[at : at + CHUNK], node[at : at + CHUNK]
                bound = np.minimum(queries[q], high[k]).sum(1, dtype=np.int64)
                # A node's overlap has to suffice with its smallest set.
                keep[at : at + CHUNK] = enough(np.minimum(bound, sizes[q]), sizes[q], np.maximum(low[k], -(-4 * sizes[q] // 5)))
            query, node = query[keep], node[keep]
        return query, self.order[node]
