"""Group-level reconciliation: one output row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import amount, composite_key, exact_sum, round_amount, signed
from ..model import GroupConfig
from .classify import group_of, status_of


def reconcile_groups(a: DataFrame, b: DataFrame, cfg: GroupConfig) -> DataFrame:
    """Compare the sums of both sides per key.

    Both sides are stacked and aggregated once, with the side as a condition inside the sums. This
    gives what a full outer join of two aggregates gives, for one exchange of partial sums instead
    of two; a hot key arrives as one partial row per task.
    """
    none = F.lit(None).cast("double")
    side_a = a.select(
        composite_key([F.col(f"`{c}`") for c in cfg.key_cols_a]).alias("chave"),
        amount(a, cfg.value_a).alias("va"),
        none.alias("vb"),
    )
    side_b = b.select(
        composite_key([F.col(f"`{c}`") for c in cfg.key_cols_b]).alias("chave"),
        none.alias("va"),
        amount(b, cfg.value_b).alias("vb"),
    )
    # An amount is never NULL on its own side, so a NULL sum means that the side is absent.
    sums = side_a.unionByName(side_b).groupBy("chave").agg(
        exact_sum(F.col("va")).alias("sa"), exact_sum(F.col("vb")).alias("sb")
    )
    both = F.col("has_a") & F.col("has_b")
    return (
        sums.select(
            "chave",
            F.coalesce(round_amount(F.col("sa")), F.lit(0.0)).alias("soma_a"),
            F.coalesce(round_amount(signed(F.col("sb"), cfg.invert)), F.lit(0.0)).alias("soma_b"),
            F.col("sa").isNotNull().alias("has_a"),
            F.col("sb").isNotNull().alias("has_b"),
        )
        .withColumn("diff", round_amount(F.col("soma_a") - F.col("soma_b")))
        .select(
            "chave",
            "soma_a",
            "soma_b",
            "diff",
            "has_a",
            "has_b",
            status_of(F.col("diff"), both).alias("status"),
            group_of(F.col("diff"), both, cfg.limit).alias("grupo"),
        )
    )
