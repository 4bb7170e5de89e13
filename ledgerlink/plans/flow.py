"""The whole run: reversals of A, cancellations of B, then reconciliation of what is left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..model import (
    GROUP_CANCELLED,
    GROUP_REVERSED,
    GROUP_REVERSED_DOCS,
    ROW_ID,
    STATUS_DIFFERENT,
    STATUS_NOT_EVALUATED,
    STATUS_NOT_FOUND,
    STATUS_RECONCILED,
    CancelConfig,
    GroupConfig,
    ReversalConfig,
    RowConfig,
)
from ..operators.cancel import cancel_marks, is_cancelled, is_kept
from ..operators.groups import reconcile_groups
from ..operators.multikey import reconcile_rows
from ..operators.results import counts_by
from ..operators.reversal import reversal_marks
from ..scratch import materialize
from ..versions import publish

_STATUSES = (STATUS_RECONCILED, STATUS_DIFFERENT, STATUS_NOT_FOUND, STATUS_NOT_EVALUATED)
_COUNTED = {"estorno_pares": GROUP_REVERSED, "estorno_docs": GROUP_REVERSED_DOCS, "canceladas": GROUP_CANCELLED}
_MARKS = f"{ROW_ID} long, status string, grupo string"


@dataclass(frozen=True)
class SavedRun:
    """A written result with its counts."""

    result: DataFrame
    distribution: DataFrame
    counters: DataFrame


@dataclass(frozen=True)
class Run:
    """Lazy results of a run. ``counters`` and ``distribution`` are computed when read; ``save`` gets
    them while it writes the result."""

    result: DataFrame
    marks_a: DataFrame
    marks_b: DataFrame
    #: Whether the result holds the marked rows, too.
    keeps_marks: bool = False

    @property
    def distribution(self) -> DataFrame:
        """Rows per status, most frequent first."""
        return counts_by(self.result, "status")

    def save(self, path: str) -> SavedRun:
        """Write the result to ``path`` (see ``publish``); counters come from the rows on their way."""
        spark = self.result.sparkSession
        seen = Observation()
        metrics = [F.count(F.lit(1)).alias("linhas"), F.count_if(F.col("status").isNull()).alias("none")]
        metrics += [F.count_if(F.col("status") == s).alias(f"s{i}") for i, s in enumerate(_STATUSES)]
        if self.keeps_marks:
            metrics += [F.count_if(F.col("grupo") == g).alias(c) for c, g in _COUNTED.items()]
        where = publish(self.result.observe(seen, *metrics).write.parquet, spark, path)
        got = seen.get
        if not self.keeps_marks:  # the marks are a table of their own
            for side, names in ((self.marks_a, ("estorno_pares", "estorno_docs")), (self.marks_b, ("canceladas",))):
                got |= side.agg(*[F.count_if(F.col("grupo") == _COUNTED[c]).alias(c) for c in names]).first().asDict()
        totals = [(s, got[f"s{i}"]) for i, s in enumerate(_STATUSES)] + [(None, got["none"])]
        totals = sorted([t for t in totals if t[1]], key=lambda t: (-t[1], t[0] or ""))
        names = [*_COUNTED, "linhas"]
        return SavedRun(
            spark.read.schema(self.result.schema).parquet(where),
            spark.createDataFrame(totals, "status string, total long"),
            spark.createDataFrame([tuple(got[c] for c in names)], ", ".join(f"{c} long" for c in names)),
        )

    @property
    def counters(self) -> DataFrame:
        """One row: reversed rows (rows, not pairs), leftover documents, cancelled, result rows."""
        in_group = [
            ("estorno_pares", self.marks_a, GROUP_REVERSED),
            ("estorno_docs", self.marks_a, GROUP_REVERSED_DOCS),
            ("canceladas", self.marks_b, GROUP_CANCELLED),
        ]
        counted = self.result.select(F.lit("linhas").alias("what"))
        for name, marks, grupo in in_group:
            counted = counted.unionByName(
                marks.filter(F.col("grupo") == grupo).select(F.lit(name).alias("what"))
            )
        names = ["estorno_pares", "estorno_docs", "canceladas", "linhas"]
        return counted.agg(*[F.count_if(F.col("what") == n).alias(n) for n in names])


def _marks(
    a: DataFrame,
    b: DataFrame,
    reversal: ReversalConfig | None,
    cancel: CancelConfig | None,
    row_id: str,
) -> tuple[DataFrame, DataFrame]:
    nothing = a.sparkSession.createDataFrame([], _MARKS)
    # Reversal marks are read by the reconciliation and by the counters: they are computed once.
    return (
        materialize(reversal_marks(a, reversal, row_id), "reversal-marks") if reversal else nothing,
        cancel_marks(b, cancel, row_id) if cancel else nothing,
    )


def run_groups(
    a: DataFrame,
    b: DataFrame,
    cfg: GroupConfig,
    reversal: ReversalConfig | None = None,
    cancel: CancelConfig | None = None,
    row_id: str = ROW_ID,
) -> Run:
    """Group-level run: marked rows leave before the sums."""
    marks_a, marks_b = _marks(a, b, reversal, cancel, row_id)
    left_a = a
    if reversal:
        gone = marks_a.select(F.col(ROW_ID).alias("_gone"))
        left_a = a.join(gone, F.col(f"`{row_id}`") == F.col("_gone"), "left_anti")
    left_b = b.filter(is_kept(cancel)) if cancel else b
    return Run(reconcile_groups(left_a, left_b, cfg), marks_a, marks_b)


def run_rows(
    a: DataFrame,
    b: DataFrame,
    cfg: RowConfig,
    reversal: ReversalConfig | None = None,
    cancel: CancelConfig | None = None,
    row_id: str = ROW_ID,
) -> Run:
    """Row-level run: marked rows keep their mark in the result.

    The cancellation mark is a condition on the row, so B is marked without a join.
    """
    marks_a, marks_b = _marks(a, b, reversal, cancel, row_id)
    cancelled = None
    if cancel:
        hit = is_cancelled(cancel)
        cancelled = F.struct(
            F.when(hit, STATUS_NOT_EVALUATED).alias("status"),
            F.when(hit, GROUP_CANCELLED).alias("grupo"),
        )
    result = reconcile_rows(a, b, cfg, marks_a if reversal else None, cancelled, row_id)
    return Run(result, marks_a, marks_b, keeps_marks=True)
