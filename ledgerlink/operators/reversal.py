"""Rows of the accounting ledger that reverse each other.

A row enters the key named by its document column as an *entry* of role A and the key named by its
reference column as an entry of role B. Under one key, entries of A choose in row order among the
entries of B whose amount cancels theirs within the tolerance. Keys do not influence each other.

Let ``m`` be the amount of an A entry and minus the amount of a B entry: two entries may pair when
their ``m`` differ by at most the tolerance. No pair crosses a gap in ``m`` wider than that, so a
key falls into independent *components*:

* a component with one role only has no pairs;
* a component no wider than the tolerance (with tolerance zero: every component) lets every A pair
  with every B. Which entries pair follows from counts and ranks alone, so hot keys with hot
  amounts need no task that sees the whole group;
* the others are paired in row order by a grouped map, one component at a time;
* of those too large for one task, one with many entries of few amounts is settled from counts per
  amount and block of rows (:mod:`.tallies`), the rest chunk by chunk (:mod:`.chunks`). All ways give
  the same pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import amount, cents_index
from ..model import (
    GROUP_REVERSED,
    GROUP_REVERSED_DOCS,
    ROW_ID,
    STATUS_NOT_EVALUATED,
    STATUS_RECONCILED,
    ReversalConfig,
)
from ..scratch import materialize
from ..sources.spread import narrow_tasks
from .chunks import pair_by_chunks, pair_whole_components
from .joins import join_lookup
from .ranks import CELL_BITS, rank_in_group
from .tallies import pair_by_counts
from .zero_sum import zero_sum_flags

# Entries of a component that one task may pair, and amounts of a key that one task may sort.
MAX_COMPONENT = 500_000
MAX_AMOUNTS = 1_000_000
# Bytes of an entry with its component in a shuffle, about.
ENTRY_BYTES = 40
# Entries per amount from which counts are much smaller than the entries themselves.
DENSE = 16


def _cents(m: Column) -> Column:
    """Cents of the entries of B with this ``m``."""
    return cents_index(F.lit(0.0) - m)


def _entries(a: DataFrame, cfg: ReversalConfig, row_id: str) -> DataFrame:
    """(key, role, m, cents, row_id, dual); ``dual`` marks rows that could meet themselves."""
    rows = a.select(
        F.col(f"`{row_id}`").cast("long").alias(ROW_ID),
        F.col(f"`{cfg.col_a}`").cast("string").alias("_ka"),
        F.col(f"`{cfg.col_b}`").cast("string").alias("_kb"),
        (amount(a, cfg.value) + F.lit(0.0)).alias("_v"),
    )
    v = F.col("_v")
    dual = F.coalesce(
        (F.col("_ka") == F.col("_kb")) & (F.abs(v + v) <= float(cfg.limit)), F.lit(False)
    )

    def entry(role: str, key: str, m: Column, cents: Column) -> Column:
        return F.struct(
            F.col(key).alias("key"),
            F.lit(role).alias("role"),
            m.alias("m"),
            cents.alias("cents"),
            dual.alias("dual"),
        )

    both = F.array(
        entry("A", "_ka", v, F.lit(0).cast("long")),
        entry("B", "_kb", F.lit(0.0) - v, cents_index(v)),
    )
    return rows.select(ROW_ID, F.inline(both)).filter("key <> ''")


def _amounts(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entry counts per (key, m), and the keys that hold both roles with their number of amounts.

    The counts are written once: the steps that follow read them several times, while the entries
    are read only here and for the final join.
    """
    is_a = F.col("role") == "A"
    counts = materialize(
        entries.groupBy("key", "m").agg(
            F.count_if(is_a).alias("na"),
            F.count_if(~is_a).alias("nb"),
            F.count_if(is_a & F.col("dual")).alias("nd"),
        ),
        "reversal-amounts",
    )
    n = counts.agg(F.sum(F.col("na") + F.col("nb"))).first()[0] or 0
    narrow_tasks(entries.sparkSession, n * ENTRY_BYTES)
    keys = (
        counts.groupBy("key")
        .agg(F.sum("na").alias("_a"), F.sum("nb").alias("_b"), F.count(F.lit(1)).alias("_amounts"))
        .filter("_a > 0 AND _b > 0")
        .select("key", "_amounts")
    )
    return counts, keys


def _components_in_key(amounts: DataFrame, limit: float) -> DataFrame:
    """Components of keys with a bounded number of amounts: one layout by key serves all steps."""
    along = Window.partitionBy("key").orderBy("m")
    whole = Window.partitionBy("key", "comp")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    of_b = F.when(F.col("nb") > 0, _cents(F.col("m")))
    clash = F.coalesce(of_b == F.last(of_b, ignorenulls=True).over(before), F.lit(False))
    gap = F.coalesce(F.col("m") - F.lag("m").over(along) > limit, F.lit(True))
    named = (
        amounts.withColumn("_start", F.when(gap, F.col("m")))
        .withColumn("_clash", clash)
        .withColumn("comp", F.last("_start", ignorenulls=True).over(along))
    )
    return named.select(
        "key",
        "m",
        "comp",
        F.sum("na").over(whole).alias("na"),
        F.sum("nb").over(whole).alias("nb"),
        F.sum("nd").over(whole).alias("nd"),
        F.count(F.lit(1)).over(whole).alias("amounts"),
        F.max("_clash").over(whole).alias("clash"),
        (F.max("m").over(whole) - F.min("m").over(whole) <= limit).alias("narrow"),
    )


def _components_in_cells(amounts: DataFrame, limit: float) -> DataFrame:
    """Components of keys with any number of amounts; no task sees all amounts of a key.

    Amounts are compared with their neighbour inside cells of the amount axis, then cells with
    their neighbour; the second step sees one row per cell of a key. The piece of a component that
    lies in one cell is added up there. Only components that go on in another cell are added up by a
    shuffle of their pieces, and only their amounts are joined with the sums.
    """
    cell_width = max(64.0 * limit, 1000.0)
    cells_of = amounts.withColumn("_cell", F.floor(F.col("m") / cell_width).cast("double"))
    inside = Window.partitionBy("key", "_cell").orderBy("m")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.col("m") - F.lag("m").over(inside) > limit
    of_b = F.when(F.col("nb") > 0, _cents(F.col("m")))
    started = cells_of.withColumn("_start", F.when(gap, F.col("m"))).withColumn("_b", of_b)

    along = Window.partitionBy("key").orderBy("_cell")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        started.groupBy("key", "_cell")
        .agg(
            F.min("m").alias("_lo"),
            F.max("m").alias("_hi"),
            F.max("_start").alias("_in"),
            F.min("_b").alias("_last_b"),  # cents of B fall where ``m`` rises
        )
        .withColumn("_prev", F.lag("_hi").over(along))
        .withColumn(
            "_fresh",
            F.when(F.col("_prev").isNull() | (F.col("_lo") - F.col("_prev") > limit), F.col("_lo")),
        )
        .withColumn("_own", F.coalesce("_in", "_fresh"))
        .withColumn("_open", F.coalesce("_fresh", F.last("_own", ignorenulls=True).over(earlier)))
        .withColumn("_goes_on", F.coalesce(F.lead("_lo").over(along) - F.col("_hi") <= limit, F.lit(False)))
        .withColumn("_b_before", F.last("_last_b", ignorenulls=True).over(earlier))
        .select("key", "_cell", "_open", F.col("_fresh").isNull().alias("_came"), "_goes_on", "_in", "_b_before")
    )
    piece = Window.partitionBy("key", "_cell", "_latest")
    last_b = F.last("_b", ignorenulls=True).over(piece.orderBy("m").rowsBetween(Window.unboundedPreceding, -1))
    first, last = F.col("_latest").isNull(), F.col("_latest").eqNullSafe(F.col("_in"))
    sums = {c: F.sum(c).over(piece) for c in ("na", "nb", "nd")}
    named = (
        started.withColumn("_latest", F.max("_start").over(upto))
        .withColumn("_clash", F.coalesce(F.col("_b") == last_b, F.lit(False)))
        .withColumns({**sums, "amounts": F.count(F.lit(1)).over(piece), "clash": F.max("_clash").over(piece)})
        .withColumns({"_from": F.min("m").over(piece), "_to": F.max("m").over(piece), "_b": F.max("_b").over(piece)})
        .join(cells, ["key", "_cell"])
        .withColumn("_apart", (first & F.col("_came")) | (last & F.col("_goes_on")))
        .withColumn("clash", F.col("clash") | (first & F.col("_came") & F.coalesce(F.col("_b") == F.col("_b_before"), F.lit(False))))
    )
    # The sums of a piece stand at its first amount, for those that are added up.
    at_first = F.col("_apart") & (F.col("m") == F.col("_from"))
    named = materialize(
        named.select(
            "key", "m", F.coalesce("_latest", "_open").alias("comp"), "na", "nb", "nd", "amounts", "clash",
            (F.col("_to") - F.col("_from") <= limit).alias("narrow"), "_apart", F.when(at_first, F.col("_to")).alias("_to"),
        ),
        "reversal-components",
    )
    whole = named.filter(~F.col("_apart")).drop("_apart", "_to")
    totals = (
        named.filter("_to IS NOT NULL")
        .groupBy("key", "comp")
        .agg(
            *[F.sum(c).alias(c) for c in ("na", "nb", "nd", "amounts")],
            F.max("clash").alias("clash"),
            (F.max("_to") - F.min("m") <= limit).alias("narrow"),
        )
    )
    spread = named.filter("_apart").select("key", "m", "comp")
    return whole.unionByName(join_lookup(spread, totals, ["key", "comp"], how="inner"))


def _component_counts(entries: DataFrame, limit: float, max_amounts: int) -> DataFrame:
    """The component of each (key, m), the component's counts and whether it is narrow.

    A component is named by its smallest ``m``. Keys without entries of both roles are left out.
    """
    counts, keys = _amounts(entries)
    if limit == 0:
        amounts = join_lookup(counts, keys.select("key"), ["key"], how="left_semi")
        alone = {"amounts": F.lit(1).cast("long"), "clash": F.lit(False), "narrow": F.lit(True)}
        return amounts.withColumns({"comp": F.col("m"), **alone})
    if counts.count() <= max_amounts:  # from the file footers; no key can have more
        return _components_in_key(counts.join(keys.select("key"), "key", "left_semi"), limit)
    many = F.col("_amounts") > max_amounts
    keys = materialize(keys, "reversal-keys")
    few_keys, many_keys = keys.filter(~many).select("key"), keys.filter(many).select("key")
    few = _components_in_key(counts.join(few_keys, "key", "left_semi"), limit)
    if many_keys.isEmpty():
        return few
    large = materialize(
        join_lookup(counts, many_keys, ["key"], how="left_semi"), "reversal-large-keys"
    )
    cells = _components_in_cells(large, limit)
    return cells if few_keys.isEmpty() else few.unionByName(cells)


def _route(max_component: int, dense: int) -> Column:
    """How the entry is settled: by its component's totals or ranks, in one task, by counts per amount
    and block, or chunk by chunk."""
    own = F.when(F.col("role") == "A", F.col("na")).otherwise(F.col("nb"))
    other = F.when(F.col("role") == "A", F.col("nb")).otherwise(F.col("na"))
    return (
        F.when(other == 0, "unpaired")
        .when(F.col("narrow") & (F.col("nd") == 0) & (own <= other), "paired")
        .when(F.col("narrow") & (F.col("nd") == 0), "rank")
        .when(F.col("narrow"), "dual")
        .when(F.col("na") + F.col("nb") <= max_component, "whole")
        .when((F.col("nd") == 0) & ~F.col("clash") & (F.col("na") + F.col("nb") >= dense * F.col("amounts")), "counts")
        .otherwise("chunk")
    )


def _ranked(entries: DataFrame, cell_bits: int) -> DataFrame:
    return rank_in_group(entries, ["key", "comp", "role"], ["cents"], ROW_ID, "rank", cell_bits)


def _pair_by_rank(entries: DataFrame, cell_bits: int) -> DataFrame:
    """With ``n`` the smaller count, the first ``n`` entries of each role pair, one by one."""
    return _ranked(entries, cell_bits).select(
        ROW_ID, (F.col("rank") <= F.least("na", "nb")).alias("paired")
    )


def _pair_by_rank_apart(entries: DataFrame, cell_bits: int) -> DataFrame:
    """The same where a row may sit in both lists, since it may not pair with itself.

    A row with the same rank in both lists swaps partners with the next rank. That works everywhere
    but at rank ``n``. There the row stays unpaired unless its rank is the second half of a swap,
    that is, when the run of equal ranks that ends at ``n`` has odd length; the entry at ``n + 1``
    of the longer list, if there is one, takes its turn.
    """
    ranked = _ranked(entries, cell_bits)
    rank_a, rank_b, n = F.col("ra"), F.col("rb"), F.least("na", "nb")
    met = (
        ranked.groupBy("key", "comp", ROW_ID)
        .agg(
            F.max(F.when(F.col("role") == "A", F.col("rank"))).alias("ra"),
            F.max(F.when(F.col("role") == "B", F.col("rank"))).alias("rb"),
            F.max(n).alias("n"),
        )
        .groupBy("key", "comp")
        .agg(
            F.max(F.when((rank_a <= F.col("n")) & ~rank_a.eqNullSafe(rank_b), rank_a)).alias("last")
        )
        .select("key", "comp", F.coalesce("last", F.lit(0)).alias("last_apart"))
    )
    rank = F.col("rank")
    own = F.when(F.col("role") == "A", F.col("na")).otherwise(F.col("nb"))
    stuck = (n - F.col("last_apart")) % 2 == 1
    loses = stuck & ((own > n) | (F.col("na") == F.col("nb")))
    paired = F.when(loses, (rank < n) | (rank == n + 1)).otherwise(rank <= n)
    return join_lookup(ranked, met, ["key", "comp"], how="inner").select(
        ROW_ID, paired.alias("paired")
    )


def _marks(flags: DataFrame) -> DataFrame:
    hit = F.col("paired")
    return flags.select(
        ROW_ID,
        F.when(hit, STATUS_RECONCILED).otherwise(STATUS_NOT_EVALUATED).alias("status"),
        F.when(hit, GROUP_REVERSED).otherwise(GROUP_REVERSED_DOCS).alias("grupo"),
    )


def reversal_marks(
    a: DataFrame,
    cfg: ReversalConfig,
    row_id: str = ROW_ID,
    max_component: int = MAX_COMPONENT,
    max_amounts: int = MAX_AMOUNTS,
    cell_bits: int = CELL_BITS,
    dense: int = DENSE,
) -> DataFrame:
    """(row_id, status, grupo) of the rows that take part in a reversal.

    A row paired under any key is reconciled; a row left over in a key that holds both roles is a
    reversed document to look at. Other rows get no mark. With ``zero_sum_groups`` the sum of a key
    decides (:mod:`.zero_sum`).
    """
    if cfg.zero_sum_groups:
        return _marks(zero_sum_flags(a, cfg, row_id))
    limit = float(cfg.limit)
    narrow_tasks(a.sparkSession)
    entries = _entries(a, cfg, row_id)
    settled = (
        join_lookup(
            entries, _component_counts(entries, limit, max_amounts), ["key", "m"], how="inner"
        )
        .withColumn("route", _route(max_component, dense))
        .drop("narrow", "dual", "amounts", "clash")
    )
    # Several routes read this frame; each reads its own folder of the copy.
    settled = materialize(settled, "reversal-entries", ["route"])
    used = {r["route"] for r in settled.select("route").distinct().collect()}  # seven at most
    reach = math.ceil(limit * 100) + 1
    routes = {
        "rank": lambda e: _pair_by_rank(e, cell_bits),
        "dual": lambda e: _pair_by_rank_apart(e, cell_bits),
        "whole": lambda e: pair_whole_components(e, limit),
        "counts": lambda e: pair_by_counts(e, limit, cell_bits),
        "chunk": lambda e: pair_by_chunks(e, limit, reach, max_component, cell_bits),
    }
    flags = settled.filter(F.col("route").isin("paired", "unpaired")).select(
        ROW_ID, (F.col("route") == "paired").alias("paired")
    )
    for route, settle in routes.items():
        if route in used:
            flags = flags.unionByName(settle(settled.filter(F.col("route") == route)))

    return _marks(flags.groupBy(ROW_ID).agg(F.max("paired").alias("paired")))
