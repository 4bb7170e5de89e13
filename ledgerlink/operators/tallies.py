"""Row-order pairing of wide components with many entries of few amounts, from counts.

Entries of A are served in row order and take the free entry of B of the lowest cents within the
tolerance. Entries of B with one amount are alike but for their turn, so the free ones are a count per
amount. Once no entry of B within reach of an amount is free, none will be again: every amount of A is
served up to some row and never after. So a component comes down to the row at which each amount of A
falls silent and the number of entries taken of each amount of B.

Rows are cut into blocks of neighbouring row ids, counted per (block, amount). As long as no amount
falls silent inside a block, the order of its rows does not matter: parked by rising amount, its counts
leave the same free entries as in any order. Parking by rising amount also leaves the fewest free
entries of all orders, and the fewer entries take part, the more stay free. That gives two bounds of
what is free after each block, equal until an amount may have fallen silent somewhere inside one. Such
blocks are counted again in finer blocks, down to single rows, and the counts are walked through
again; each round refines all doubtful blocks of all components at once, so the number of rounds is
that of bits of a row id by STEP_BITS, and in the last one the bounds are equal everywhere.

A task holds one count per amount of B, and streams the counts of A; it never sees the entries.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ROW_ID
from ..scratch import materialize
from .joins import join_lookup
from .ranks import rank_in_group

#: The rows of a component are first cut into 2 ** FIRST_BITS blocks; a doubtful one is cut into
#: 2 ** STEP_BITS.
FIRST_BITS, STEP_BITS = 10, 6

_COMPONENT = ["key", "comp"]


class Spots:
    """Free entries of B of one component, by amount, while blocks of A are parked."""

    def __init__(self, amounts: list[float], counts: list[int], limit: float) -> None:
        self.amounts = amounts  # rising
        self.counts = counts
        self.limit = limit
        self.most = list(counts)  # free at most
        self.least = list(counts)  # free at least
        self.exact = True  # both are the same
        self.silent: dict[float, int] = {}  # first block without a free entry in reach, by amount of A
        self.doubtful: list[int] = []
        self._reach: dict[float, tuple[int, int]] = {}

    def reach(self, m: float) -> tuple[int, int]:
        """The run of amounts of B that may pair with an entry of A."""
        if m not in self._reach:
            amounts, target, limit = self.amounts, -m, self.limit
            lo, hi = bisect_left(amounts, target - limit), bisect_right(amounts, target + limit)
            # The search bounds are rounded; the edges are settled by the test that defines a pair.
            while lo > 0 and abs(amounts[lo - 1] - target) <= limit:
                lo -= 1
            while lo < hi and abs(amounts[lo] - target) > limit:
                lo += 1
            while hi < len(amounts) and abs(amounts[hi] - target) <= limit:
                hi += 1
            while hi > lo and abs(amounts[hi - 1] - target) > limit:
                hi -= 1
            self._reach[m] = lo, hi
        return self._reach[m]

    def block(self, start: int, single: bool, counts: list[tuple[float, int]]) -> None:
        """Park a block of rows, given as (m, number of entries), that follows the blocks before."""
        before = [0, *accumulate(self.most)]
        live = []
        for m, n in sorted(counts, reverse=True):  # by rising amount
            lo, hi = self.reach(m)
            if before[hi] > before[lo]:
                live.append((lo, hi, n))
            else:
                self.silent.setdefault(m, start)
        if not live:
            return
        if not (single and self.exact):
            least = list(self.least)
            _park(least, live)
            after = [0, *accumulate(least)]
            safe = [x for x in live if after[x[1]] > after[x[0]]]
            if len(safe) < len(live):
                if not single:
                    self.doubtful.append(start)
                _park(self.most, safe)
                self.least, self.exact = least, False
                return
        _park(self.most, live)
        if self.exact:
            self.least = self.most
        else:
            self.least = least

    def taken(self) -> list[int]:
        return [n - free for n, free in zip(self.counts, self.most)]


def _park(free: list[int], entries: list[tuple[int, int, int]]) -> None:
    """Let entries, given by their reach and number in rising order, take the first free places."""
    at = 0
    for lo, hi, n in entries:
        at = max(at, lo)
        while n and at < hi:
            k = min(n, free[at])
            free[at] -= k
            n -= k
            if n:
                at += 1


def _counted(a: DataFrame, shift: int) -> DataFrame:
    """Entries of A per block of ``2 ** shift`` row ids and amount."""
    start = F.col(ROW_ID).bitwiseAND(F.lit(-(1 << shift)))
    return a.groupBy(*_COMPONENT, start.alias("start"), "m").agg(F.count(F.lit(1)).alias("n")).withColumn("single", F.lit(shift == 0))


_FOUND = "key string, comp double, kind string, start long, m double"


def _walk(spots: DataFrame, tallies: DataFrame, limit: float) -> DataFrame:
    """For each component its doubtful blocks (kind ``doubt``: start), if there are any; else the row
    from which each silent amount of A gets nothing (kind ``A``: m, start) and how many entries of each
    amount of B are taken (kind ``B``: m, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, spots, block, rows = None, None, None, []
        out: list[tuple] = []

        def close_block() -> None:
            if rows:
                spots.block(block[0], block[1], rows)
                rows.clear()

        def close_component() -> None:
            close_block()
            key, comp = place
            if spots.doubtful:
                out.extend((key, comp, "doubt", s, None) for s in spots.doubtful)
            else:
                out.extend((key, comp, "A", s, m) for m, s in spots.silent.items())
                out.extend((key, comp, "B", n, 0.0 - v) for v, n in zip(spots.amounts, spots.taken()))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            kinds = (pa.string(), pa.float64(), pa.string(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in _FOUND.split(", ")])

        amounts: list[float] = []
        counts: list[int] = []
        for batch in batches:
            for key, comp, role, start, single, m, n in zip(*(c.to_pylist() for c in batch.columns)):
                if place != (key, comp):
                    if place is not None:
                        if spots is None:
                            spots = Spots(amounts, counts, limit)
                        close_component()
                    place, spots, amounts, counts = (key, comp), None, [], []
                if role == "B":
                    amounts.append(0.0 - m)
                    counts.append(n)
                    continue
                if spots is None:
                    spots = Spots(amounts, counts, limit)
                if rows and block != (start, single):
                    close_block()
                block = start, single
                rows.append((m, n))
            if len(out) > 10_000:
                yield flush()
        if place is not None:
            if spots is None:
                spots = Spots(amounts, counts, limit)
            close_component()
        yield flush()

    # Role B comes first, by rising amount; blocks of A in row order.
    rank = F.when(F.col("role") == "B", 0).otherwise(1)
    both = spots.select(*_COMPONENT, F.lit("B").alias("role"), F.lit(None).cast("long").alias("start"), F.lit(False).alias("single"), "m", "n").unionByName(
        tallies.select(*_COMPONENT, F.lit("A").alias("role"), "start", "single", "m", "n")
    )
    laid = both.repartition(*_COMPONENT).sortWithinPartitions(*_COMPONENT, rank, "start", F.desc("m"))
    return laid.select(*_COMPONENT, "role", "start", "single", "m", "n").mapInArrow(run, _FOUND)


def pair_by_counts(entries: DataFrame, limit: float, cell_bits: int) -> DataFrame:
    """(row_id, paired) of components in which no row may meet itself and every amount of B has cents
    of its own."""
    a, b = (entries.filter(F.col("role") == r).select(*_COMPONENT, "m", ROW_ID) for r in "AB")
    low, high = a.agg(F.min(ROW_ID), F.max(ROW_ID)).first()
    shift = max(0, (high - low).bit_length() - FIRST_BITS)
    spots = materialize(b.groupBy(*_COMPONENT, "m").agg(F.count(F.lit(1)).alias("n")), "reversal-spots")
    tallies = materialize(_counted(a, shift), "reversal-tallies")
    ends, open_spots = None, spots
    while True:
        found = materialize(_walk(open_spots, tallies, limit), "reversal-ends")
        settled = found.filter("kind <> 'doubt'")
        ends = settled if ends is None else ends.unionByName(settled)
        doubt = found.filter("kind = 'doubt'").select(*_COMPONENT, "start")
        if doubt.isEmpty():
            break
        # A block that is not doubtful never becomes so: finer counts only bring the bounds closer.
        block = F.col(ROW_ID).bitwiseAND(F.lit(-(1 << shift)))
        inside = join_lookup(a.withColumn("start", block), doubt, [*_COMPONENT, "start"], how="left_semi").select(*a.columns)
        still = doubt.select(*_COMPONENT).distinct()
        kept = join_lookup(tallies, still, _COMPONENT, how="left_semi")
        kept = join_lookup(kept, doubt, [*_COMPONENT, "start"], how="left_anti")
        shift = max(0, shift - STEP_BITS)
        tallies = materialize(kept.unionByName(_counted(inside, shift)), "reversal-tallies")
        open_spots = join_lookup(spots, still, _COMPONENT, how="left_semi")

    amount = [*_COMPONENT, "m"]
    silent = ends.filter("kind = 'A'").select(*amount, F.col("start").alias("silent"))
    served = join_lookup(a, silent, amount).select(ROW_ID, (F.col("silent").isNull() | (F.col(ROW_ID) < F.col("silent"))).alias("paired"))
    taken = ends.filter("kind = 'B'").select(*amount, F.col("start").alias("taken"))
    ranked = rank_in_group(join_lookup(b, taken, amount), amount, [], ROW_ID, "rank", cell_bits)
    return served.unionByName(ranked.select(ROW_ID, (F.col("rank") <= F.col("taken")).alias("paired")))
