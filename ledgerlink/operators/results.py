"""Reading results: counts, filters, pages and comparison of two results."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ROW_ID
from ..scratch import materialize

NULL_STATUS = "__NULL__"

# Rows that are sorted to find a page, and ranges in which more of them are counted at a time.
LEAF_ROWS = 100_000
RANGES = 64


def counts_by(result: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first. Used for ``status`` and ``grupo``."""
    return (
        result.groupBy(column)
        .agg(F.count(F.lit(1)).alias("total"))
        .orderBy(F.desc("total"), F.asc_nulls_first(column))
    )


def total_rows(result: DataFrame) -> DataFrame:
    return result.agg(F.count(F.lit(1)).alias("total"))


def _contains(c: str, term: str) -> Column:
    # ``%`` and ``_`` in the term are wildcards; a backslash is an ordinary character.
    pattern = "%" + term.replace("\\", "\\\\") + "%"
    return F.col(f"`{c}`").cast("string").ilike(pattern)


def filter_result(
    result: DataFrame,
    status: str | None = None,
    search: str | None = None,
    column: str | None = None,
) -> DataFrame:
    """Rows of one status (``__NULL__`` for none) whose ``column`` contains ``search``.

    A search without a column, or on a column that does not exist, does not filter.
    """
    out = result
    if status == NULL_STATUS:
        out = out.filter(F.col("status").isNull())
    elif status:
        out = out.filter(F.col("status") == status)
    if search and column and column in result.columns:
        out = out.filter(_contains(column, search))
    return out


def search_any(result: DataFrame, search: str | None) -> DataFrame:
    if not search:
        return result
    return result.filter(reduce(Column.__or__, [_contains(c, search) for c in result.columns]))


def preview(df: DataFrame, limit: int = 50) -> DataFrame:
    return df.limit(limit)


def page(
    result: DataFrame,
    number: int,
    size: int = 50,
    order: Sequence[str] = (ROW_ID, "origem"),
) -> DataFrame:
    """The ``number``-th page (from 1) in the order of any columns, NULLs first.

    The result is written once. While more than LEAF_ROWS rows may hold the page, they are counted in
    ranges between sampled values of the order columns, and only the ranges of the page are looked
    at further; so no rows but the last few are sorted, however deep the page lies. The sample only
    places the bounds, the counts are exact. Rows that are equal in the order columns follow a hash of
    the whole row, so pages of one result never overlap unless rows are equal in every column.
    """
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    (tie,) = _unused(result, "_tie")
    rows = materialize(result.withColumn(tie, F.xxhash64(*[F.col(f"`{c}`") for c in result.columns])), "result-page")
    by = [*order, tie]
    key = F.struct(*[F.col(f"`{c}`") for c in by])
    skip, n = (number - 1) * size, rows.count()
    inside = F.lit(True)
    while n > max(LEAF_ROWS, size) and skip < n:
        part = rows.filter(inside)
        bounds = _bounds(part, key, n)
        counts = {r["range"]: r["n"] for r in part.groupBy(_range_of(key, bounds).alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()}
        first, before = 0, 0
        while before + counts.get(first, 0) <= skip:
            before += counts.get(first, 0)
            first += 1
        last, held = first, counts[first]
        while before + held < min(skip + size, n):
            last += 1
            held += counts.get(last, 0)
        if held == n:  # equal rows, or a page as long as they
            break
        if first:
            inside = inside & (key >= bounds[first - 1])
        if last < len(bounds):
            inside = inside & (key < bounds[last])
        skip, n = skip - before, held
    return rows.filter(inside).orderBy(*[F.col(f"`{c}`") for c in by]).offset(skip).limit(size).select(*[F.col(f"`{c}`") for c in result.columns])


def _unused(df: DataFrame, *names: str) -> list[str]:
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (f"{name}{'_' * k}" for k in range(len(taken) + 1)) if n not in taken) for name in names]


def _bounds(part: DataFrame, key: Column, n: int) -> list[Column]:
    """At most RANGES - 1 rising values of the order columns, from a sample of a bounded size."""
    kind = part.select(key.alias("k")).schema[0].dataType
    drawn = F.pmod(F.xxhash64(F.lit(n), key), F.lit(max(1, n // (RANGES * 32)))) == 0
    seen = part.filter(drawn).select(key.alias("k")).limit(RANGES * 256).distinct().orderBy("k").collect()
    chosen = [seen[i * len(seen) // RANGES]["k"] for i in range(1, RANGES)] if seen else []
    values = list(dict.fromkeys(chosen))

    def literal(row) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind.fields)])

    return [literal(v) for v in values]


def _range_of(key: Column, bounds: list[Column], offset: int = 0) -> Column:
    """Number of bounds at or below the key, by halving."""
    if not bounds:
        return F.lit(offset)
    half = len(bounds) // 2
    return F.when(key < bounds[half], _range_of(key, bounds[:half], offset)).otherwise(
        _range_of(key, bounds[half + 1 :], offset + half + 1)
    )


def page_info(result: DataFrame, size: int = 50) -> DataFrame:
    """One row: total rows and number of pages."""
    return result.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(size)).cast("long").alias("total_pages")
    )


def key_columns(result: DataFrame) -> list[str]:
    return [c for c in result.columns if re.fullmatch(r"CHAVE_\d+", c)]


def diff_results(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that only one result has, or that carry different values in the two.

    Both results hold a key once. They are stacked and grouped, so one exchange serves the key-set
    difference in both directions and the comparison of the intersection.
    """

    def tagged(df: DataFrame, on_left: bool) -> DataFrame:
        return df.select(
            F.col(f"`{key}`").alias("chave"),
            F.col(f"`{value}`").alias("v"),
            F.lit(on_left).alias("is_left"),
        )

    is_left = F.col("is_left")
    merged = (
        tagged(left, True)
        .unionByName(tagged(right, False))
        .groupBy("chave")
        .agg(
            F.max(is_left).alias("in_left"),
            F.max(~is_left).alias("in_right"),
            F.max(F.when(is_left, F.col("v"))).alias("left_value"),
            F.max(F.when(~is_left, F.col("v"))).alias("right_value"),
        )
    )
    kind = (
        F.when(~F.col("in_right"), "only_left")
        .when(~F.col("in_left"), "only_right")
        .when(~F.col("left_value").eqNullSafe(F.col("right_value")), "diverging")
    )
    return (
        merged.withColumn("kind", kind)
        .filter("kind IS NOT NULL")
        .select("chave", "kind", "left_value", "right_value")
    )


def diff_counts(difference: DataFrame) -> DataFrame:
    kinds = ("only_left", "only_right", "diverging")
    return difference.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
