"""Delimited text: a header row somewhere near the top, all values as text."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..model import ROW_ID
from .catalog import named_columns
from .records import numbered_records, quote_states

_DELIMITERS = ",;|\t"
_SNIFFED_LINES = 20


@dataclass(frozen=True)
class TextSpec:
    """Where the table starts: header row and first column, both from 1."""

    header_row: int = 1
    start_col: int = 1
    delimiter: str | None = None
    encoding: str = "UTF-8"

    def __post_init__(self) -> None:
        if self.header_row < 1 or self.start_col < 1:
            raise ValueError("header_row and start_col start at 1")


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that cuts the most of these lines into the same number (above one) of fields."""

    def score(d: str) -> tuple[int, int]:
        widths = [len(r) for r in csv.reader(lines, delimiter=d)]
        common = max(set(widths), key=lambda w: (widths.count(w), w), default=1)
        return (widths.count(common), common) if common > 1 else (0, 0)

    best = max(_DELIMITERS, key=score)
    return best if score(best) > (0, 0) else ","


def _is_utf8(spec: TextSpec) -> bool:
    return spec.encoding.upper().replace("-", "") == "UTF8"


def _whole_lines(spark: SparkSession, path: str, spec: TextSpec, header: str | None = None) -> DataFrame:
    """Lines that are not blank as one column ``line``; with ``header``, all files must begin with that line, which is left out."""
    # No text holds the separator; a line that does is an error.
    options = {"sep": "\u0001", "quote": "", "encoding": spec.encoding, "mode": "FAILFAST"}
    schema = StructType([StructField("line" if header is None else header, StringType())])
    read = spark.read.options(header=header is not None, enforceSchema=header is None, **options)
    return read.schema(schema).csv(path).toDF("line")


def _top(spark: SparkSession, path: str, spec: TextSpec) -> tuple[list[str], str, str]:
    """Header cells, delimiter and header line, from the first lines of the file."""
    wanted = spec.header_row + _SNIFFED_LINES
    top = spark.read.text(path) if _is_utf8(spec) else _whole_lines(spark, path, spec)
    lines = [r[0] for r in top.take(wanted)]
    if len(lines) < spec.header_row:
        raise ValueError(f"{path} ends before header row {spec.header_row}")
    table = [line.removeprefix("\ufeff").rstrip("\r") for line in lines[spec.header_row - 1 :]]
    delimiter = spec.delimiter or sniff_delimiter([t for t in table if t])
    header = next(csv.reader([table[0]], delimiter=delimiter), [])
    if not any(cell.strip() for cell in header[spec.start_col - 1 :]):
        raise ValueError(f"{path} has no column from {spec.start_col} on in row {spec.header_row}")
    return header, delimiter, table[0]


def read_delimited(
    spark: SparkSession,
    path: str,
    spec: TextSpec = TextSpec(),
    row_id: str | None = ROW_ID,
) -> DataFrame:
    """Ledger of text columns named from the header, with rows numbered from 0 in file order.

    Files in UTF-8, one or many, are read in splits; rows keep their order, files in name order, and a
    quoted field may go on over several lines (see :mod:`.records`). Other encodings are read line by
    line: they need a header on the first line, have no row ids (``row_id=None``), and a line break inside
    quotes is an error there.

    Short rows are filled with NULL. Longer rows, a quote that is never closed and a file whose header
    line is not that of the first file are errors.
    """
    header, delimiter, header_line = _top(spark, path, spec)
    raw = [f"_c{i}" for i in range(len(header))]
    # One field more than the header has, to notice rows that are too long.
    schema = ", ".join(f"`{c}` string" for c in [*raw, "_extra"])
    options = {"sep": delimiter, "encoding": spec.encoding, "escape": '"', "mode": "PERMISSIVE"}
    kept = raw[spec.start_col - 1 :]
    # The number of the row takes part, so that no line is judged before it is known to be a record.
    fits = F.when(F.col("_extra").isNull() | F.col("at").isNull(), True).otherwise(
        F.raise_error(F.lit(f"{path}: a row has more fields than the header")).cast("boolean")
    )

    if _is_utf8(spec):
        records = numbered_records(spark, path, delimiter, spec.header_row, header_line)
    elif spec.header_row == 1 and row_id is None:
        lines = _whole_lines(spark, path, spec, header_line).select(F.lit(0).alias("at"), "line")
        records = lines.filter(
            F.when(~quote_states(F.col("line"), delimiter)[0], True).otherwise(
                F.raise_error(F.lit(f"{path}: line break inside quotes")).cast("boolean")
            )
        )
    else:
        raise ValueError("row ids and a header below row 1 need files in UTF-8")
    body = (
        records.select("at", F.from_csv("line", schema, options).alias("r"))
        .select("at", "r.*")
        .filter(fits)
    )
    named = named_columns(body.select(*kept), header[spec.start_col - 1 :], spec.start_col)
    place = [F.col("at").alias(row_id)] if row_id else []
    return body.select(
        *place,
        *[
            F.col(c).alias(f.name, metadata=f.metadata)
            for c, f in zip(kept, named.schema.fields)
        ],
    )
