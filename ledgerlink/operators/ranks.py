"""Row ranks inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 20


def rank_in_group(
    df: DataFrame,
    group: Sequence[str],
    leading: Sequence[str],
    row_id: str,
    out: str,
    cell_bits: int = CELL_BITS,
) -> DataFrame:
    """Add the 1-based rank of each row in its group, ordered by ``leading`` and then ``row_id``.

    Row ids are distinct inside a group, so a cell of ``2**cell_bits`` neighbouring ids holds at
    most that many rows of one group and one leading value. Rows are ranked inside their cell. The
    rows before a cell are counted in two steps, cells of the same leading values first and then
    whole leading values, so that neither running sum sees more than one row per cell of one
    leading value, or per leading value. No task sorts a whole group, however large the group is.
    """
    block = [*group, *leading]
    cell = [*block, "_cell"]
    celled = df.withColumn("_cell", F.shiftright(F.col(row_id), cell_bits))
    in_cell = Window.partitionBy(*cell).orderBy(row_id)
    earlier = Window.unboundedPreceding, -1
    cells_before = Window.partitionBy(*block).orderBy("_cell").rowsBetween(*earlier)
    counts = celled.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(cells_before), F.lit(0)))
    if leading:
        blocks_before = Window.partitionBy(*group).orderBy(*leading).rowsBetween(*earlier)
        blocks = (
            counts.groupBy(*block)
            .agg(F.sum("_n").alias("_m"))
            .withColumn("_ahead", F.coalesce(F.sum("_m").over(blocks_before), F.lit(0)))
        )
        offsets = offsets.join(blocks, block).withColumn(
            "_offset", F.col("_offset") + F.col("_ahead")
        )
    ranked = celled.withColumn("_rank", F.row_number().over(in_cell))
    return (
        ranked.join(offsets.select(*cell, "_offset"), cell)  # both sides are laid out by cell
        .withColumn(out, F.col("_rank") + F.col("_offset"))
        .drop("_rank", "_offset", "_cell")
    )
