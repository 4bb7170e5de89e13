"""Join of many rows to a table that holds each key once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    row_keys: Sequence[Column] | None = None,
) -> DataFrame:
    """Join ``rows`` to ``lookup`` on the columns ``on`` of ``lookup``.

    ``row_keys`` gives the matching expressions on ``rows``; by default the columns of that name.
    The key columns of ``lookup`` are dropped when expressions are given.

    One key may own a large share of ``rows``. Adaptive execution splits such a partition only
    when *both* inputs of the join come straight from an exchange. A lookup that was just
    aggregated by the same key would be joined in place and block the split, so the hash of the
    key joins as a second column: both inputs are then exchanged for this join, the hot partition
    of ``rows`` is cut by map output and its few lookup rows are read by every piece. A lookup
    that turns out small at run time is broadcast by the same mechanism.
    """
    left, names = rows, list(on)
    if row_keys is not None:
        names = [f"_jk{i}" for i in range(len(on))]
        left = rows.withColumns(dict(zip(names, row_keys)))
    theirs = [f"_rk{i}" for i in range(len(on))]
    left = left.withColumn("_jh", F.xxhash64(*names))
    right = lookup.withColumnsRenamed(dict(zip(on, theirs)))
    right = right.withColumn("_rh", F.xxhash64(*theirs))
    condition = F.col("_jh") == F.col("_rh")
    for mine, their in zip(names, theirs):
        condition = condition & (F.col(mine) == F.col(their))
    added = names if row_keys is not None else []
    return left.join(right, condition, how).drop("_jh", "_rh", *theirs, *added)
