"""What is known about the columns of a ledger, kept in the field metadata of its DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import unique_names


def named_columns(df: DataFrame, headers: Sequence[object], start_col: int = 1) -> DataFrame:
    """Rename all columns from their header cells and remember the header in the metadata."""
    names = unique_names(headers, start_col - 1)
    return df.select(
        *[
            F.col(f"`{old}`").alias(new, metadata={"source_name": source, "monetary": False})
            for old, new, source in zip(
                df.columns, names, ["" if h is None else str(h) for h in headers]
            )
        ]
    )


def _described(df: DataFrame, change: dict[str, dict]) -> DataFrame:
    return df.select(
        *[
            F.col(f"`{f.name}`").alias(f.name, metadata={**f.metadata, **change[f.name]})
            if f.name in change
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def column_catalog(df: DataFrame) -> DataFrame:
    """(col_index, source_name, name, is_monetary), one row per column."""
    rows = [
        (i, f.metadata.get("source_name", f.name), f.name, bool(f.metadata.get("monetary")))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "col_index int, source_name string, name string, is_monetary boolean"
    )


def monetary_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.metadata.get("monetary")]


def set_monetary(df: DataFrame, cols: Iterable[str], value: bool = True) -> DataFrame:
    cols = list(cols)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    return _described(df, {c: {"monetary": value} for c in cols})


def copy_monetary(
    src: DataFrame, dst: DataFrame, match_by: str = "name", override: bool = False
) -> tuple[DataFrame, int]:
    """Flag the columns of ``dst`` whose name (or source name) is flagged in ``src``.

    Returns the frame and the number of columns touched: with ``override`` all that match,
    otherwise those that were not flagged yet.
    """
    if match_by not in ("name", "source_name"):
        raise ValueError("match_by is name or source_name")

    def label(f):
        return f.name if match_by == "name" else f.metadata.get("source_name", f.name)

    flagged = {label(f) for f in src.schema.fields if f.metadata.get("monetary")}
    change = {
        f.name: {"monetary": True}
        for f in dst.schema.fields
        if label(f) in flagged and (override or not f.metadata.get("monetary"))
    }
    return _described(dst, change), len(change)


def map_columns(
    columns_a: Sequence[str],
    columns_b: Sequence[str],
    pairs: Sequence[tuple[str, str]] = (),
) -> dict[str, str | None]:
    """Column of B for each column of A: the given pair, else the same name, else none."""
    given = dict(pairs)
    on_b = set(columns_b)
    return {c: given.get(c, c if c in on_b else None) for c in columns_a if c}


def mapped_pairs(mapping: dict[str, str | None]) -> list[tuple[str, str]]:
    return [(a, b) for a, b in mapping.items() if b and b.strip()]
