"""Results as spreadsheet workbooks (.xlsx), one or more per partition, written by the tasks.

Files are named by partition, so that their name order is the order of the rows, and appear under their
name when they are whole: a task that runs twice replaces its own files. Values keep their kind: truth
values, numbers and texts; NULL is an empty cell. There are no styles.
"""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from decimal import Decimal
from itertools import chain
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..sources.workbook import MAIN_NAMESPACE, OFFICE_RELATIONS, PACKAGE_RELATIONS

# Rows of a sheet by the file format.
MOST_ROWS = 1_048_576

_CONTROL = re.compile(rf"[\x00-\x08\x0b\x0c\x0e-\x1f{chr(0xFFFE)}{chr(0xFFFF)}]")
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_OFFICE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def column_letters(number: int) -> str:
    """Letters of a column, counted from 1."""
    letters = ""
    while number:
        number, last = divmod(number - 1, 26)
        letters = chr(ord("A") + last) + letters
    return letters


def _cell(reference: str, value: object) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    number = isinstance(value, (int, Decimal)) or isinstance(value, float) and value - value == 0
    if number:
        shown = repr(value) if isinstance(value, float) else str(value)
        return f'<c r="{reference}"><v>{shown}</v></c>'
    # Characters that XML cannot hold are spelt as the file format does.
    text = _CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value))
    text = escape(text, {"\r": "&#13;"})
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _row(number: int, first_col: int, values: Sequence[object]) -> str:
    cells = [_cell(f"{column_letters(first_col + i)}{number}", v) for i, v in enumerate(values)]
    return f'<row r="{number}">{"".join(cells)}</row>'


def _frame(book: zipfile.ZipFile, sheet: str) -> None:
    """The members of a workbook with one sheet, but for the sheet itself."""
    kinds = {"xl/workbook.xml": "sheet.main", "xl/worksheets/sheet1.xml": "worksheet"}
    listed = "".join(f'<Override PartName="/{m}" ContentType="{_OFFICE}.{k}+xml"/>' for m, k in kinds.items())
    rels = 'ContentType="application/vnd.openxmlformats-package.relationships+xml"'

    def link(kind: str, target: str) -> str:
        return (
            f'{_HEAD}<Relationships xmlns="{PACKAGE_RELATIONS}">'
            f'<Relationship Id="rId1" Type="{OFFICE_RELATIONS}/{kind}" Target="{target}"/></Relationships>'
        )

    book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="rels" {rels}/>{listed}</Types>')
    book.writestr("_rels/.rels", link("officeDocument", "xl/workbook.xml"))
    book.writestr("xl/_rels/workbook.xml.rels", link("worksheet", "worksheets/sheet1.xml"))
    name = escape(sheet, {'"': "&quot;"})
    book.writestr(
        "xl/workbook.xml",
        f'{_HEAD}<workbook xmlns="{MAIN_NAMESPACE}" xmlns:r="{OFFICE_RELATIONS}"><sheets>'
        f'<sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>',
    )


def _write(
    path: str, rows: Iterator[list], headers: Sequence[str], first_row: int, first_col: int, sheet: str, most: int
) -> int:
    """One workbook with rows up to row ``most`` of its sheet; returns their number."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        _frame(book, sheet)
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
            out.write(f'{_HEAD}<worksheet xmlns="{MAIN_NAMESPACE}"><sheetData>'.encode())
            out.write(_row(first_row, first_col, headers).encode())
            for values in rows:
                n += 1
                out.write(_row(first_row + n, first_col, values).encode())
                if first_row + n >= most:
                    break
            out.write(b"</sheetData></worksheet>")
    return n


def write_workbooks(
    df: DataFrame,
    folder: str,
    headers: Sequence[str] | None = None,
    first_row: int = 1,
    first_col: int = 1,
    sheet: str = "Plan1",
    last_row: int = MOST_ROWS,
) -> DataFrame:
    """Write ``df`` into a new folder that all executors can open; (path, rows) per workbook.

    ``headers`` are the header cells, the column names by default, in row ``first_row`` from column
    ``first_col`` on. A partition with rows beyond row ``last_row`` fills several workbooks; one
    without rows gets none. An existing folder is an error. A row of NULLs and empty texts alone is an
    empty row, at which readers of workbooks stop.
    """
    target = folder.removeprefix("file:")
    if os.path.exists(target):
        raise ValueError(f"{target} exists")
    names = list(df.columns if headers is None else headers)
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} headers for {len(df.columns)} columns")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (list(values) for b in batches for values in zip(*[c.to_pylist() for c in b.columns]))
        part = TaskContext.get().partitionId()
        os.makedirs(target, exist_ok=True)
        done = []
        ahead = next(rows, None)
        while ahead is not None:
            name = f"part-{part:06d}-{len(done):04d}.xlsx"
            draft = os.path.join(target, f".{name}-{uuid.uuid4().hex}")
            # A chain leaves ``rows`` open when the workbook is full.
            n = _write(draft, chain([ahead], rows), names, first_row, first_col, sheet, last_row)
            os.replace(draft, os.path.join(target, name))
            done.append((os.path.join(target, name), n))
            ahead = next(rows, None)
        yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "rows": [n for _, n in done]}, pa.schema([("path", pa.string()), ("rows", pa.int64())]))

    made = df.mapInArrow(write, "path string, rows long")
    return df.sparkSession.createDataFrame(made.toArrow())
