"""Load a ledger by the kind of file it sits in."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ROW_ID
from ..versions import published
from .delimited import TextSpec, read_delimited
from .rowid import parquet_with_row_id
from .workbook import SheetSpec, read_workbooks


def _kind_of_folder(spark: SparkSession, path: str) -> str:
    """The one extension of a folder's files; hidden files and markers do not count."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        raise ValueError(f"nothing at {path}")
    names = [f.getPath().getName() for f in system.listStatus(folder) if f.isFile()]
    kinds = {os.path.splitext(n)[1].lower() for n in names if n[0] not in "._"}
    if len(kinds) != 1:
        raise ValueError(f"{path} holds {', '.join(sorted(kinds)) or 'no files'}; one kind is needed")
    return kinds.pop()


def load_base(
    spark: SparkSession,
    path: str,
    header_row: int = 1,
    start_col: int = 1,
    sheet: str | None = None,
    row_id: str = ROW_ID,
    delimiter: str | None = None,
    encoding: str = "UTF-8",
) -> DataFrame:
    """Ledger with a row id and text columns from .csv, .txt, .xlsx or Parquet, one file or a folder of one kind."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower() or _kind_of_folder(spark, path)
    if kind in (".csv", ".txt"):
        return read_delimited(spark, path, TextSpec(header_row, start_col, delimiter, encoding), row_id)
    if kind == ".xlsx":
        return read_workbooks(spark, path, SheetSpec(header_row, start_col, sheet), row_id)
    if kind == ".parquet":
        df = parquet_with_row_id(spark, published(spark, path), row_id)
        return df.select(
            row_id, *[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns if c != row_id]
        )
    raise ValueError(f"unsupported format: {kind} ({path})")
