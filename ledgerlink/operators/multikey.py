"""Row-level reconciliation by prioritised keys: one output row per input row.

Both ledgers travel as one tagged frame that holds only what matching needs: side, row id, parsed
amount, and the raw key and value columns in shared *slots* (the j-th used column of A and the j-th
used column of B share a slot). Key texts and the JSON payload are built from the slots, so no step
looks back into the ledgers.

Each pass aggregates the unmatched rows by its key (partial sums first, so a hot key costs one row
per task), keeps keys present on both sides, and joins them back. Sums of a later key depend on the
removals of an earlier one, so a pass that is followed by another is written once, partitioned by
whether the row matched: the matched part goes straight to the result and only the rest takes part
in the next pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (
    amount,
    composite_key,
    exact_sum,
    round_amount,
    row_payload,
    signed,
)
from ..model import (
    GROUP_NOT_FOUND,
    ROW_ID,
    STATUS_NOT_FOUND,
    KeyDef,
    RowConfig,
)
from ..scratch import materialize
from .classify import group_of, status_of
from .joins import join_lookup

_OUTCOME = ("key_id", "status", "grupo", "chave_valor", "value_a", "value_b", "difference")


class _Slots:
    """Which raw column of each side sits in which slot, in the order in which they are first needed."""

    def __init__(self, cfg: RowConfig) -> None:
        self.of: dict[str, dict[str, str]] = {"A": {}, "B": {}}
        for k in cfg.keys:
            self._add("A", *k.cols_a)
            self._add("B", *k.cols_b)
        self._add("A", cfg.value_a)
        self._add("B", cfg.value_b)
        self.names = [f"_s{i}" for i in range(max(map(len, self.of.values())))]

    def _add(self, side: str, *columns: str) -> None:
        for c in columns:
            self.of[side].setdefault(c, f"_s{len(self.of[side])}")

    def raw(self, side: str) -> list[Column]:
        held = {slot: F.col(f"`{c}`") for c, slot in self.of[side].items()}
        return [held.get(n, F.lit(None)).cast("string").alias(n) for n in self.names]

    def key(self, k: KeyDef) -> Column:
        on_a = composite_key([self.of["A"][c] for c in k.cols_a])
        on_b = composite_key([self.of["B"][c] for c in k.cols_b])
        return F.when(F.col("origem") == "A", on_a).otherwise(on_b)

    def payload(self, side: str) -> Column:
        named = [(c, F.col(n)) for c, n in self.of[side].items()]
        return F.when(F.col("origem") == side, row_payload(named))


def _side(
    df: DataFrame,
    side: str,
    cfg: RowConfig,
    slots: _Slots,
    marks: DataFrame | Column | None,
    row_id: str,
) -> DataFrame:
    value = cfg.value_a if side == "A" else cfg.value_b
    no_text = F.lit(None).cast("string")
    mark = marks if isinstance(marks, Column) else F.struct(
        no_text.alias("status"), no_text.alias("grupo")
    )
    frame = df.select(
        F.lit(side).alias("origem"),
        F.col(f"`{row_id}`").cast("long").alias(ROW_ID),
        amount(df, value).alias("_val"),
        *slots.raw(side),
        mark["status"].alias("_mark_status"),
        mark["grupo"].alias("_mark_grupo"),
    )
    if isinstance(marks, DataFrame):
        given = marks.select(
            F.col(ROW_ID).cast("long").alias("_mid"),
            F.col("status").alias("_mark_status"),
            F.col("grupo").alias("_mark_grupo"),
        )
        frame = frame.drop("_mark_status", "_mark_grupo").join(
            given, F.col(ROW_ID) == F.col("_mid"), "left"
        ).drop("_mid")
    return frame


def _own_amount(invert: bool) -> tuple[Column, Column]:
    """Amounts of a row that was compared with nothing: its own, on its own side."""
    on_a = F.col("origem") == "A"
    zero = F.lit(0.0)
    return (
        F.when(on_a, round_amount(F.col("_val"))).otherwise(zero),
        F.when(on_a, zero).otherwise(round_amount(signed(F.col("_val"), invert))),
    )


def _outcome(values: dict[str, Column]) -> list[Column]:
    return [values[c].alias(c) for c in _OUTCOME]


def _pass(rest: DataFrame, key: KeyDef, slots: _Slots, cfg: RowConfig) -> DataFrame:
    """Join the unmatched rows to the groups of this key that have rows on both sides."""
    keyed = rest.withColumn("_k", slots.key(key))
    on_a = F.col("origem") == "A"
    sums = keyed.groupBy("_k").agg(
        exact_sum(F.when(on_a, F.col("_val"))).alias("_sa"),
        exact_sum(F.when(~on_a, F.col("_val"))).alias("_sb"),
    )
    both = F.lit(True)
    groups = (
        sums.filter("_sa IS NOT NULL AND _sb IS NOT NULL")
        .select(
            "_k",
            round_amount(F.col("_sa")).alias("_ga"),
            round_amount(signed(F.col("_sb"), cfg.invert)).alias("_gb"),
        )
        .withColumn("_gd", round_amount(F.col("_ga") - F.col("_gb")))
        .select(
            "_k",
            "_ga",
            "_gb",
            "_gd",
            status_of(F.col("_gd"), both).alias("_status"),
            group_of(F.col("_gd"), both, cfg.limit).alias("_grupo"),
        )
    )
    return join_lookup(keyed, groups, ["_k"]).withColumn("_hit", F.col("_status").isNotNull())


def reconcile_rows(
    a: DataFrame,
    b: DataFrame,
    cfg: RowConfig,
    marks_a: DataFrame | Column | None = None,
    marks_b: DataFrame | Column | None = None,
    row_id: str = ROW_ID,
) -> DataFrame:
    """Classify every row of both ledgers.

    Marks take rows out before the first key. They come as a frame (row_id, status, grupo) or,
    when the mark is a condition on the row itself, as a struct column (status, grupo) that is
    NULL inside for unmarked rows; the latter needs no join.
    """
    slots = _Slots(cfg)
    rows = _side(a, "A", cfg, slots, marks_a, row_id).unionByName(
        _side(b, "B", cfg, slots, marks_b, row_id)
    )
    carried = ["origem", ROW_ID, "_val", *slots.names]
    marked = None
    if marks_a is not None or marks_b is not None:
        rows = rows.withColumn("_marked", F.col("_mark_status").isNotNull())
        if isinstance(marks_a, DataFrame) or isinstance(marks_b, DataFrame):
            rows = materialize(rows, "marked-rows", ["_marked"])
        marked = rows.filter("_marked")
        rows = rows.filter("NOT _marked")
    rest = rows.select(*carried)

    own_a, own_b = _own_amount(cfg.invert)
    no_text = F.lit(None).cast("string")
    parts = []
    if marked is not None:
        parts.append(
            marked.select(
                *carried,
                *_outcome(
                    {
                        "key_id": no_text,
                        "status": F.col("_mark_status"),
                        "grupo": F.col("_mark_grupo"),
                        "chave_valor": no_text,
                        "value_a": own_a,
                        "value_b": own_b,
                        "difference": F.lit(0.0),
                    }
                ),
            )
        )

    last = len(cfg.keys) - 1
    for i, key in enumerate(cfg.keys):
        hit = F.col("_hit")
        found = _outcome(
            {
                "key_id": F.when(hit, F.lit(key.key_id)),
                "status": F.coalesce(F.col("_status"), F.lit(STATUS_NOT_FOUND)),
                "grupo": F.coalesce(F.col("_grupo"), F.lit(GROUP_NOT_FOUND)),
                "chave_valor": F.when(hit, F.col("_k")),
                "value_a": F.when(hit, F.col("_ga")).otherwise(own_a),
                "value_b": F.when(hit, F.col("_gb")).otherwise(own_b),
                "difference": F.when(hit, F.col("_gd")).otherwise(round_amount(own_a - own_b)),
            }
        )
        step = _pass(rest, key, slots, cfg)
        if i < last:
            step = materialize(step, f"pass-{i + 1}", ["_hit"])
            rest = step.filter("NOT _hit").select(*carried)
            step = step.filter("_hit")
        parts.append(step.select(*carried, *found))

    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select(
        "origem",
        ROW_ID,
        *_OUTCOME,
        *[slots.key(k).alias(k.key_id) for k in cfg.keys],
        slots.payload("A").alias("a_values"),
        slots.payload("B").alias("b_values"),
    )
