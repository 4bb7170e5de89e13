"""Copy columns from an origin table to a destination table by prioritised keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_key_value, composite_key, import_value, is_empty
from ..model import ONLY_EMPTY, RESERVED_COLUMNS, ROW_ID, AttributionConfig, AttributionKey
from .joins import join_lookup


def _text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def _key_part(cfg: AttributionConfig) -> Callable[[Column], Column]:
    """Keys join on their raw text unless clean-up was asked for."""
    return clean_key_value if cfg.clean_keys else lambda c: c


def _first_rows(
    origin: DataFrame, key: AttributionKey, cfg: AttributionConfig, row_id: str, out: str
) -> DataFrame:
    """One row per key of the origin: the row with the lowest id, with the columns to copy.

    Reducing before the join keeps the join many-to-one, whatever the number of origin rows that
    share a key.
    """
    part = _key_part(cfg)
    names = [f"_ok{i}" for i in range(len(key.pairs))]
    have = set(origin.columns)
    copied = [
        (_text(c) if c in have else F.lit(None).cast("string")).alias(f"v{i}")
        for i, c in enumerate(cfg.selected)
    ]
    keyed = origin.select(
        *[part(_text(o)).alias(n) for n, (_, o) in zip(names, key.pairs)],
        F.struct(F.col(f"`{row_id}`").cast("long").alias("row"), *copied).alias("_hit"),
    )
    return (
        keyed.na.drop(subset=names)
        .groupBy(*names)
        .agg(F.min_by("_hit", F.col("_hit.row")).alias(out))
    )


def _matched(
    origin: DataFrame, dest: DataFrame, cfg: AttributionConfig, row_id: str
) -> DataFrame:
    """Destination with the origin row (``_hit``) of the first key that finds one (``_matched``).

    Origin rows are never used up, so the keys do not depend on each other.
    """
    part = _key_part(cfg)
    usable = [k for k in cfg.keys if k.pairs]
    if not usable:
        raise ValueError("no key has columns on both sides")
    joined = dest
    for i, key in enumerate(usable):
        reduced = _first_rows(origin, key, cfg, row_id, "_found")
        joined = join_lookup(
            joined,
            reduced,
            [c for c in reduced.columns if c != "_found"],
            row_keys=[part(_text(d)) for d, _ in key.pairs],
        )
        hit = F.col("_found")
        by = F.when(hit.isNotNull(), F.lit(key.key_id))
        if i:
            hit, by = F.coalesce("_hit", hit), F.coalesce("_matched", by)
        joined = joined.withColumns({"_hit": hit, "_matched": by}).drop("_found")
    return joined


def _new_values(cfg: AttributionConfig, dest_columns: Sequence[str]) -> dict[str, Column]:
    have = set(dest_columns)
    values = {}
    for i, c in enumerate(cfg.selected):
        imported = import_value(F.col("_hit")[f"v{i}"])
        if cfg.mode == ONLY_EMPTY and c in have:
            own = F.col(f"`_dest_{c}`")
            values[c] = F.when(is_empty(own), imported).otherwise(own)
        else:
            values[c] = imported
    return values


def attribute(
    origin: DataFrame, dest: DataFrame, cfg: AttributionConfig, row_id: str = ROW_ID
) -> DataFrame:
    """(dest_row_id, orig_row_id, matched_key, selected columns, one column per key id).

    Only destination rows that some key matched are in the result.
    """
    shown = [k for k in cfg.keys if k.dest_cols]
    needed = list(dict.fromkeys(c for k in cfg.keys for c in k.dest_cols))
    own = [c for c in cfg.selected if c in dest.columns] if cfg.mode == ONLY_EMPTY else []
    narrow = dest.select(
        F.col(f"`{row_id}`").cast("long").alias("dest_row_id"),
        *[_text(c).alias(c) for c in needed],
        *[_text(c).alias(f"_dest_{c}") for c in own],
    )
    values = _new_values(cfg, dest.columns)
    return (
        _matched(origin, narrow, cfg, row_id)
        .filter("_hit IS NOT NULL")
        .select(
            "dest_row_id",
            F.col("_hit.row").alias("orig_row_id"),
            F.col("_matched").alias("matched_key"),
            *[v.alias(c) for c, v in values.items()],
            *[composite_key([f"`{c}`" for c in k.dest_cols]).alias(k.key_id) for k in shown],
        )
    )


def attribution_counts(result: DataFrame, cfg: AttributionConfig) -> DataFrame:
    """Rows per matched key, in key order; a key that matched nothing counts zero."""
    order = [(i, k.key_id) for i, k in enumerate(cfg.keys) if k.pairs]
    rows = result.agg(
        *[F.count_if(F.col("matched_key") == key_id).alias(f"n{i}") for i, key_id in order]
    )
    entries = [
        F.struct(F.lit(key_id).alias("matched_key"), F.col(f"n{i}").alias("total"))
        for i, key_id in order
    ]
    return rows.select(F.inline(F.array(*entries)))


def write_back(
    origin: DataFrame,
    dest: DataFrame,
    cfg: AttributionConfig,
    row_id: str = ROW_ID,
    protected: Sequence[str] = (),
) -> DataFrame:
    """All destination rows and columns, with the selected columns replaced where a key matched.

    Reserved columns, the row id and the ``protected`` ones keep their values. A selected column
    that the destination lacks is added, NULL where nothing matched.
    """
    fixed = {*RESERVED_COLUMNS, row_id, *protected, *[k.key_id for k in cfg.keys]}
    targets = [c for c in cfg.selected if c not in fixed]
    # Matching runs on narrow rows; the wide rows meet its result once, by their distinct ids.
    found = attribute(origin, dest, replace(cfg, selected=targets), row_id).select(
        "dest_row_id", *[F.col(f"`{c}`").alias(f"_new_{c}") for c in targets]
    )
    matched = F.col("dest_row_id").isNotNull()

    def column(c: str) -> Column:
        if c not in targets:
            return F.col(f"`{c}`")
        before = _text(c) if c in dest.columns else F.lit(None).cast("string")
        return F.when(matched, F.col(f"`_new_{c}`")).otherwise(before).alias(c)

    added = [c for c in targets if c not in dest.columns]
    return dest.join(found, F.col(f"`{row_id}`") == F.col("dest_row_id"), "left").select(
        *[column(c) for c in [*dest.columns, *added]]
    )
