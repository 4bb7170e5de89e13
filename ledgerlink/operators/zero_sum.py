"""Reversals by group: rows whose amounts sum to zero under one key.

A row belongs to the key in its document column and to the key in its reference column, once if both
are the same. A key that at least two rows name, one as document and one as reference, is a group. If its
sum, rounded to six decimals, is within the tolerance, all its rows are reversed; else they are
documents to look at. A row that one of its groups reverses is reversed.

Rows with a NULL or empty key are in no group by it; an amount that is no number counts as 0. Rows
are told apart by row id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import amount, exact_sum
from ..model import ROW_ID, ReversalConfig
from ..scratch import materialize
from .joins import join_lookup


def _members(a: DataFrame, cfg: ReversalConfig, row_id: str) -> DataFrame:
    """(row_id, key, as_doc, as_ref, v), one row per row and key."""
    rows = a.select(
        F.col(f"`{row_id}`").cast("long").alias(ROW_ID),
        F.col(f"`{cfg.col_a}`").cast("string").alias("_ka"),
        F.col(f"`{cfg.col_b}`").cast("string").alias("_kb"),
        (amount(a, cfg.value) + F.lit(0.0)).alias("v"),
    )
    same = F.col("_ka").eqNullSafe(F.col("_kb"))

    def member(key: str, as_doc, as_ref):
        return F.struct(F.col(key).alias("key"), as_doc.alias("as_doc"), as_ref.alias("as_ref"))

    keys = F.when(same, F.array(member("_ka", F.lit(True), F.lit(True)))).otherwise(
        F.array(member("_ka", F.lit(True), F.lit(False)), member("_kb", F.lit(False), F.lit(True)))
    )
    return rows.select(ROW_ID, "v", F.inline(keys)).filter("key <> ''")


def zero_sum_flags(a: DataFrame, cfg: ReversalConfig, row_id: str = ROW_ID) -> DataFrame:
    """(row_id, paired) of the rows in some group; ``paired`` if one of its groups sums to zero.

    The narrow members are written once. A hot key arrives at its group as one partial row per task,
    and its members meet the group's one row in a join that adaptive execution can split.
    """
    members = materialize(_members(a, cfg, row_id), "zero-sum-members")
    groups = (
        members.groupBy("key")
        .agg(
            exact_sum(F.col("v")).alias("_sum"),
            F.count(F.lit(1)).alias("_n"),
            F.max("as_doc").alias("_docs"),
            F.max("as_ref").alias("_refs"),
        )
        .filter("_n > 1 AND _docs AND _refs")
        .select("key", (F.abs("_sum") <= float(cfg.limit)).alias("paired"))
    )
    met = join_lookup(members.select(ROW_ID, "key"), groups, ["key"], how="inner")
    return met.groupBy(ROW_ID).agg(F.max("paired").alias("paired"))
