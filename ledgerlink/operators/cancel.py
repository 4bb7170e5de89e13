"""Documents of the tax ledger that were cancelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import GROUP_CANCELLED, ROW_ID, STATUS_NOT_EVALUATED, CancelConfig


def _indicator(cfg: CancelConfig) -> tuple[Column, str]:
    c = F.col(f"`{cfg.column}`").cast("string")
    return (F.lower(F.trim(c)), cfg.value.strip().lower()) if cfg.relaxed else (c, cfg.value)


def is_cancelled(cfg: CancelConfig) -> Column:
    """True for cancelled rows, NULL for rows without an indicator. Reaches the scan as a filter."""
    c, value = _indicator(cfg)
    return c == value


def is_kept(cfg: CancelConfig) -> Column:
    """True for all other rows, those without an indicator included. Reaches the scan, too."""
    c, value = _indicator(cfg)
    return c.isNull() | (c != value)


def cancel_marks(b: DataFrame, cfg: CancelConfig, row_id: str = ROW_ID) -> DataFrame:
    return b.filter(is_cancelled(cfg)).select(
        F.col(row_id).cast("long").alias(ROW_ID),
        F.lit(STATUS_NOT_EVALUATED).alias("status"),
        F.lit(GROUP_CANCELLED).alias("grupo"),
    )
