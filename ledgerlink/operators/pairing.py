"""Pairing of amounts in row order, for entries that sit in one task.

This is the small helper that runs inside Spark tasks; Spark decides which entries meet there.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd


def _next_open(jump: list[int], i: int) -> int:
    """First queue at or after ``i`` that still has entries, with path halving."""
    while jump[i] != i:
        jump[i] = jump[jump[i]]
        i = jump[i]
    return i


class Queues:
    """Entries of role B, waiting for entries of role A that are served in row order.

    An entry of A gets the free entry of B in its group with another row id whose ``m`` differs by
    at most ``limit``, lowest cents first and lowest row id inside equal cents.

    Entries of B with one amount form a queue in row order, and queues sit in order of amount, that
    is, of falling ``m``. The candidates of an entry are a run of queues; used-up queues are jumped
    over. An entry costs a search in its group, however many candidates it has.
    """

    def __init__(
        self, group: np.ndarray, ids: np.ndarray, m: np.ndarray, cents: np.ndarray, limit: float
    ) -> None:
        order = np.lexsort((ids, -m, group))
        g, amount = group[order], -m[order]
        change = (g[1:] != g[:-1]) | (amount[1:] != amount[:-1])
        first = np.flatnonzero(np.r_[True, change])[: len(order)]
        self.limit = limit
        self.paired = np.zeros(len(ids), dtype=bool)
        self._bounds = g[first]
        self._amounts = amount[first].tolist()
        self._cents = cents[order][first].tolist()
        self._heads = first.tolist()
        self._ends = [*self._heads[1:], len(order)]
        self._jump = list(range(len(self._amounts) + 1))
        self._entry = array("q", order.astype(np.int64).tobytes())
        self._row = array("q", ids[order].astype(np.int64).tobytes())

    def serve(self, group: np.ndarray, ids: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Flags of the entries of A that get a partner; they come in row order, call after call."""
        served = np.zeros(len(ids), dtype=bool)
        amounts, cents, heads, ends = self._amounts, self._cents, self._heads, self._ends
        jump, row, limit = self._jump, self._row, self.limit
        least_of = np.searchsorted(self._bounds, group, side="left").tolist()
        most_of = np.searchsorted(self._bounds, group, side="right").tolist()
        for i, (own, target, least, most) in enumerate(
            zip(ids.tolist(), (-m).tolist(), least_of, most_of)
        ):
            lo = bisect_left(amounts, target - limit, least, most)
            hi = bisect_right(amounts, target + limit, lo, most)
            # The search bounds are rounded; the edges are settled by the test that defines a pair.
            while lo > least and abs(amounts[lo - 1] - target) <= limit:
                lo -= 1
            while lo < hi and abs(amounts[lo] - target) > limit:
                lo += 1
            while hi < most and abs(amounts[hi] - target) <= limit:
                hi += 1
            while hi > lo and abs(amounts[hi - 1] - target) > limit:
                hi -= 1

            best = best_at = None
            q = _next_open(jump, lo)
            while q < hi:
                if best is not None and cents[q] != cents[best]:
                    break
                at = heads[q]
                if row[at] == own:
                    at += 1
                if at < ends[q] and (best is None or row[at] < row[best_at]):
                    best, best_at = q, at
                q = _next_open(jump, q + 1)
            if best is not None:
                served[i] = True
                self._take(best, best_at)
        return served

    def _take(self, queue: int, at: int) -> None:
        head = self._heads[queue]
        self.paired[self._entry[at]] = True
        if at != head:  # the head stays and takes the place of the one behind it
            self._entry[at], self._row[at] = self._entry[head], self._row[head]
        self._heads[queue] = head + 1
        if head + 1 == self._ends[queue]:
            self._jump[queue] = queue + 1


def pair_in_row_order(entries: pd.DataFrame, group: np.ndarray, limit: float) -> np.ndarray:
    """Flag the entries (columns role, m, cents, row_id) that pair inside their group."""
    is_a = (entries["role"] == "A").to_numpy()
    m, ids = entries["m"].to_numpy(), entries["row_id"].to_numpy()
    side_a, side_b = np.flatnonzero(is_a), np.flatnonzero(~is_a)
    side_a = side_a[np.argsort(ids[side_a], kind="stable")]
    queues = Queues(
        group[side_b], ids[side_b], m[side_b], entries["cents"].to_numpy()[side_b], limit
    )
    paired = np.zeros(len(entries), dtype=bool)
    paired[side_a] = queues.serve(group[side_a], ids[side_a], m[side_a])
    paired[side_b] = queues.paired
    return paired
