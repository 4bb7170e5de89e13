"""Row-order pairing of wide components, whole or cut along the amount axis.

Both lists rank their partners the same way for everybody (A by row id; B by cents, then row id),
so letting the entries of A choose in row order and letting the entries of B choose in cents order
gives the same pairs. In the second reading an entry of B only looks at amounts within the
tolerance, which makes the work local: the amount axis is cut into chunks, and a chunk depends on
the chunk before it through the entries of A that both can reach, nothing else.

All chunks are paired at once, at first as if no shared entry had been taken. Where a chunk took
shared entries, the next one is paired again without them. Round by round chunks are merged into runs
of twice the length, and a run is paired again as a whole if what it shares with the run before has
changed. Inside a run nothing is left to be told, so after as many rounds as the number of chunks has
binary digits a component is one run at most, and the result is exact; in practice an influence dies out
after a few chunks. Only runs that are paired again are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ROW_ID
from ..scratch import materialize
from .joins import join_lookup
from .pairing import Queues, pair_in_row_order
from .ranks import rank_in_group


def pair_whole_components(entries: DataFrame, limit: float) -> DataFrame:
    """Pair components of bounded size, many in each batch.

    Rows arrive sorted by component. A batch ends inside a component as a rule, so the rows of the
    last one wait for the next batch; a task holds one batch and one component at a time.
    """

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        paired = pair_in_row_order(pdf, np.cumsum(_starts(pdf)) - 1, limit)
        return pd.DataFrame({ROW_ID: pdf[ROW_ID], "paired": paired})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            if waiting and not _starts(pd.concat([waiting[-1].tail(1), pdf]))[1:].any():
                waiting.append(pdf)
                continue
            pdf = pd.concat([*waiting, pdf], ignore_index=True)
            cut = int(np.flatnonzero(_starts(pdf))[-1])
            waiting = [pdf.iloc[cut:]]
            if cut:
                yield settle(pdf.iloc[:cut])
        if waiting:
            yield settle(pd.concat(waiting, ignore_index=True))

    return (
        entries.select("key", "comp", "role", "m", "cents", ROW_ID)
        .repartition("key", "comp")
        .sortWithinPartitions("key", "comp")
        .mapInPandas(run, f"{ROW_ID} long, paired boolean")
    )


def _starts(pdf: pd.DataFrame, by: tuple[str, ...] = ("key", "comp")) -> np.ndarray:
    """True where a row differs from the row before it in one of the columns."""
    fresh = np.zeros(len(pdf), dtype=bool)
    fresh[0] = True
    for c in by:
        values = pdf[c].to_numpy()
        fresh[1:] |= values[1:] != values[:-1]
    return fresh


def _copies(entries: DataFrame, reach: int, chunk_rows: int, cell_bits: int) -> DataFrame:
    """Entries with their chunk: B once, A in each of the at most two chunks that can take it.

    Cells are as wide as the reach of one entry of A, so an entry of A touches two of them at most.
    A chunk is a run of cells and closes when it holds ``chunk_rows`` entries. An amount with more
    entries than the other role has within reach can use only that many of them, plus one for a row
    that may not pair with itself; later ones are left out here and stay unpaired.
    """
    width = 2 * reach + 1
    target = F.when(
        F.col("role") == "A", F.floor(F.lit(-100.0) * F.col("m") + F.lit(0.5)).cast("long")
    ).otherwise(F.col("cents"))
    span = F.when(F.col("role") == "A", F.lit(reach)).otherwise(F.lit(0))

    def cell(c: Column) -> Column:
        return F.floor(c / F.lit(width)).cast("long")

    placed = entries.select(
        "key",
        "comp",
        "role",
        "m",
        "cents",
        ROW_ID,
        F.explode(F.array_distinct(F.array(cell(target - span), cell(target + span)))).alias("cell"),
    )
    is_a = F.col("role") == "A"
    ordered = Window.partitionBy("key", "comp").orderBy("cell")
    cells = (
        placed.groupBy("key", "comp", "cell")
        .agg(F.count_if(is_a).alias("ca"), F.count_if(~is_a).alias("cb"))
        .filter("ca > 0 AND cb > 0")
    )
    useful = join_lookup(placed, cells, ["key", "comp", "cell"], how="inner")
    room = useful.groupBy("key", "comp", "role", "m", "cents", ROW_ID).agg(
        F.sum(F.when(is_a, F.col("cb")).otherwise(F.col("ca"))).alias("room"),
        F.collect_set("cell").alias("cells"),  # two at most
    )
    ranked = rank_in_group(room, ["key", "comp", "role", "m"], [], ROW_ID, "rank", cell_bits)
    kept = materialize(
        ranked.filter(F.col("rank") <= F.col("room") + 1).select(
            "key", "comp", "role", "m", "cents", ROW_ID, F.explode("cells").alias("cell")
        ),
        "reversal-cells",
    )
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        kept.groupBy("key", "comp", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "key",
            "comp",
            "cell",
            F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / chunk_rows)
            .cast("long")
            .alias("chunk"),
        )
    )
    return (
        join_lookup(kept, chunks, ["key", "comp", "cell"], how="inner")
        .groupBy("key", "comp", "role", "m", "cents", ROW_ID)
        .agg(F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk"))
        .withColumn("chunk", F.explode(F.array_distinct(F.array("first_chunk", "last_chunk"))))
        .withColumn("shared", F.col("first_chunk") < F.col("last_chunk"))
        .withColumn("later", F.col("shared") & (F.col("chunk") == F.col("last_chunk")))
        .withColumnRenamed("first_chunk", "first")
        .drop("last_chunk")
    )


_STATE = (
    f"key string, comp double, first long, chunk long, role string, m double, cents long, {ROW_ID} long, "
    "shared boolean, later boolean, taken boolean, paired boolean"
)
_RUN = ("key", "comp", "run")


class _OpenRun:
    """The run of chunks that a task is reading: entries of B first, then entries of A in row order."""

    def __init__(self, place: tuple, limit: float) -> None:
        self.place = place
        self.limit = limit
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.queues: Queues | None = None

    def add(self, b: pd.DataFrame) -> None:
        self.parts.append(tuple(b[c].to_numpy() for c in (ROW_ID, "m", "cents", "chunk")))  # B is never shared

    def _open(self) -> Queues:
        if self.queues is None:
            empty = [tuple(np.array([], t) for t in (np.int64, float, np.int64, np.int64))]
            self.ids, self.m, self.cents, self.chunk = map(np.concatenate, zip(*(self.parts or empty)))
            self.parts = []
            group = np.zeros(len(self.ids), dtype=np.int8)
            self.queues = Queues(group, self.ids, self.m, self.cents, self.limit)
        return self.queues

    def serve(self, a: pd.DataFrame) -> pd.DataFrame:
        # The later copy of an entry that the run holds twice stands aside.
        free = ~(a["taken"].to_numpy(dtype=bool) | a["inside"].to_numpy(dtype=bool))
        paired = np.zeros(len(a), dtype=bool)
        ids, m = a[ROW_ID].to_numpy()[free], a["m"].to_numpy()[free]
        paired[free] = self._open().serve(np.zeros(len(ids), dtype=np.int8), ids, m)
        return a.assign(paired=paired)

    def close(self) -> pd.DataFrame:
        queues = self._open()
        rows = pd.DataFrame(
            {"first": self.chunk, "chunk": self.chunk, "role": "B", "m": self.m, "cents": self.cents, ROW_ID: self.ids, "paired": queues.paired}
        )
        never = dict.fromkeys(("shared", "later", "taken"), False)
        return rows.assign(key=self.place[0], comp=self.place[1], **never)


def _run(level: int, chunk: str = "chunk") -> Column:
    """Runs of ``2 ** level`` chunks."""
    return F.shiftright(chunk, level)


def _pair_runs(state: DataFrame, limit: float, level: int) -> DataFrame:
    """Pair every run of ``state`` on its own.

    A run streams through its task in batches. The task keeps a few numbers per entry of B and nothing
    of A, so that a run may be much larger than what fits a data frame.
    """
    names = [f.split()[0] for f in _STATE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: _OpenRun | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            out = []
            cuts = np.flatnonzero(_starts(pdf, _RUN)).tolist()
            for begin, end in zip(cuts, [*cuts[1:], len(pdf)]):
                piece = pdf.iloc[begin:end]
                place = tuple(piece.iloc[0][list(_RUN)])
                if held is None or held.place != place:
                    if held is not None:
                        out.append(held.close())
                    held = _OpenRun(place, limit)
                is_a = (piece["role"] == "A").to_numpy()
                if not is_a.all():
                    held.add(piece[~is_a])
                if is_a.any():
                    out.append(held.serve(piece[is_a]))
            if out:
                yield pd.concat(out)[names]
        if held is not None:
            yield held.close()[names]

    inside = F.col("later") & (_run(level, "first") == _run(level))
    return (
        state.select(*names, _run(level).alias("run"), inside.alias("inside"))
        .repartition(*_RUN)
        .sortWithinPartitions(*_RUN, F.desc("role"), ROW_ID, "later")
        .mapInPandas(run, _STATE)
    )


def pair_by_chunks(
    entries: DataFrame, limit: float, reach: int, chunk_rows: int, cell_bits: int
) -> DataFrame:
    """Pair components of any size; ``taken`` is what a chunk was last told by its predecessor."""
    copies = _copies(entries, reach, chunk_rows, cell_bits).withColumns(
        {"taken": F.lit(False), "paired": F.lit(None).cast("boolean")}
    )
    state, level = materialize(_pair_runs(copies, limit, 0), "reversal-chunks"), 0
    while True:
        # What neighbouring runs share; what a run shares with itself is settled.
        apart = _run(level, "first") < _run(level)
        early = state.filter("shared AND NOT later").select(
            "key", "comp", ROW_ID, F.col("paired").alias("told")
        )
        news = join_lookup(state.filter("later").filter(apart), early, ["key", "comp", ROW_ID], how="inner")
        news = materialize(
            news.filter("told <> taken").select("key", "comp", "chunk", ROW_ID, "later", "told"), "reversal-news"
        )
        if news.isEmpty():
            break
        level += 1
        stale = news.select("key", "comp", _run(level).alias("run")).distinct().withColumn("stale", F.lit(True))
        known = join_lookup(state.withColumn("run", _run(level)), stale, list(_RUN)).drop("run")
        again = join_lookup(
            known.filter("stale"),
            news.select("key", "comp", ROW_ID, "later", "told"),
            ["key", "comp", ROW_ID, "later"],
        ).withColumn("taken", F.coalesce("told", "taken"))
        kept = known.filter("stale IS NULL").drop("stale")
        state = kept.unionByName(materialize(_pair_runs(again, limit, level), "reversal-chunks"))
    # Entries that were left out of the chunks never pair.
    settled = state.select(ROW_ID, "paired")
    return settled.unionByName(entries.select(ROW_ID, F.lit(False).alias("paired")))
