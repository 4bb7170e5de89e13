"""Stable row ids in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import ROW_ID
from ..scratch import materialize
from .spread import broadcast_if_small


def parquet_with_row_id(spark: SparkSession, path: str | list[str], out: str = ROW_ID) -> DataFrame:
    """Parquet rows numbered from 0, files in name order and rows in file order.

    The position inside a file comes from the reader. Files are offset by the row counts of those
    before them: a table with one row per file, counted from the footers' row positions alone. That
    table is broadcast unless there are very many files, so the rows of the table are not moved.
    """
    paths = [path] if isinstance(path, str) else path
    df = spark.read.parquet(*paths)
    located = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_at"),
    )
    files = (
        df.select(F.col("_metadata.file_path").alias("_file"))
        .groupBy("_file")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        files.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")),
        "file-starts",
    )
    return (
        located.join(broadcast_if_small(starts), "_file")
        .withColumn(out, F.col("_start") + F.col("_at"))
        .select(out, *df.columns)
    )


def duplicate_row_ids(df: DataFrame, column: str = ROW_ID) -> DataFrame:
    """(row_id, n) of the ids that occur more than once; a NULL id counts as one, too, from its first row.

    Ids are counted as bits of cells of 64 neighbours, put together before the shuffle, so ids that
    lie together in the table cost one row per cell and task. A cell with fewer bits than rows holds a
    duplicate; only the ids of such cells are counted one by one.
    """
    ids = df.select(F.col(f"`{column}`").cast("long").alias(ROW_ID))
    cell, bit = F.shiftright(ROW_ID, 6), F.expr(f"shiftleft(1L, cast({ROW_ID} & 63 as int))")
    cells = (
        ids.select(cell.alias("_cell"), bit.alias("_bit"))
        .groupBy("_cell")
        .agg(F.bit_or("_bit").alias("_bits"), F.count(F.lit(1)).alias("_n"))
    )
    suspect = materialize(
        cells.filter("_cell IS NULL OR _n > bit_count(_bits)").select("_cell"), "row-id-suspects"
    )
    hit = cell.eqNullSafe(F.col("_cell"))
    doubtful = ids.join(broadcast_if_small(suspect), hit, "left_semi")
    counts = doubtful.groupBy(ROW_ID).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(f"n > 1 OR {ROW_ID} IS NULL")


def check_row_ids(df: DataFrame, column: str = ROW_ID) -> None:
    """Raise if an id is NULL or occurs more than once: results name rows by their ids."""
    wrong = duplicate_row_ids(df, column).orderBy(ROW_ID).limit(5).collect()
    if wrong:
        shown = ", ".join(f"{r[ROW_ID]} ({r['n']} rows)" for r in wrong)
        raise ValueError(f"{column} is no row id: {shown}")


def with_row_id(df: DataFrame, column: str, out: str = ROW_ID, check: bool = True) -> DataFrame:
    """Use a unique whole-number column as row id; its values are checked in a job of their own.

    ``check=False`` is for columns known to be unique.
    """
    if check:
        check_row_ids(df, column)
    return df.select(
        F.col(f"`{column}`").cast("long").alias(out), *[F.col(f"`{c}`") for c in df.columns if c != out]
    )
