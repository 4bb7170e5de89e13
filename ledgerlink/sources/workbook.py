"""Spreadsheet workbooks (.xlsx) as a Spark data source: one task per part of a sheet.

A folder of workbooks is read in parallel across its files. A large sheet is cut into ranges of its
unpacked bytes: each task unpacks the sheet up to its range, noticing row numbers only, and parses the
rows that start inside. Unpacking takes a small part of the time of parsing, and a sheet has MOST_PARTS
ranges at most, so the work grows with the sheet and not with its square.

The table of a sheet ends at its first empty row. A task returns the first run of rows without a gap in
its part; runs that do not join on to those before are left out afterwards, by a table with one row
per part.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import IO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.names import unique_names
from ..model import ROW_ID
from ..scratch import materialize
from .spread import broadcast_if_small

# Unpacked bytes of a sheet for one task; files below a 32nd of it are not opened to find out.
SPLIT_BYTES = 64 * 1024 * 1024
# Ranges of one sheet; those of a larger sheet are longer. Tasks stream their range.
MOST_PARTS = 16
CHUNK = 1024 * 1024

_SHEET_DATA = re.compile(rb"<(?:\w+:)?sheetData\s*(/?)>")
_ROW_TAG = re.compile(rb"<(?:\w+:)?row(?:\s[^>]*)?>")
_ROW_NUMBER = re.compile(rb"\sr\s*=\s*[\"'](\d+)[\"']")

# Namespaces of the file format.
MAIN_NAMESPACE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"

_MAIN = f"{{{MAIN_NAMESPACE}}}"
_REL_ID = f"{{{OFFICE_RELATIONS}}}id"
_REL = f"{{{PACKAGE_RELATIONS}}}"


@dataclass(frozen=True)
class SheetSpec:
    """Header row and first column (from 1), and the sheet; the first sheet by default."""

    header_row: int = 1
    start_col: int = 1
    sheet: str | None = None


def cell_text(value: object) -> str | None:
    """Text of a typed cell: TRUE/FALSE, whole numbers without a point, NULL for nothing."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return f"{value:.0f}" if value.is_integer() else repr(value)
    return str(value)


@lru_cache(maxsize=20_000)  # a sheet has 16,384 columns
def _column_index(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]*", reference).group():
        n = n * 26 + ord(letter) - ord("A") + 1
    return n


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    texts = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{_MAIN}si":
                texts.append(_plain(node))
                node.clear()
    return texts


def _plain(node: ElementTree.Element) -> str:
    """Text of a plain or formatted string, without phonetic hints."""
    parts = [*node.findall(f"{_MAIN}t"), *node.findall(f"{_MAIN}r/{_MAIN}t")]
    return "".join(p.text or "" for p in parts)


def _sheet_member(book: zipfile.ZipFile, sheet: str | None) -> str:
    workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = workbook.findall(f"{_MAIN}sheets/{_MAIN}sheet")
    chosen = [s for s in sheets if sheet is None or s.get("name") == sheet]
    if not chosen:
        raise ValueError(f"{book.filename} has no sheet {sheet}")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in links.findall(f"{_REL}Relationship")}
    target = targets[chosen[0].get(_REL_ID)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _cell_value(cell: ElementTree.Element, shared: list[str]) -> object:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inline = cell.find(f"{_MAIN}is")
        return None if inline is None else _plain(inline)
    raw = cell.findtext(f"{_MAIN}v")
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return raw == "1"
    return float(raw) if kind == "n" else raw


def _row_nodes(f: IO[bytes], lo: int, hi: int) -> Iterator[tuple[int, ElementTree.Element]]:
    """(row number, node) of the rows whose tag starts at the bytes ``lo`` to ``hi`` of the sheet.

    A row without a number follows the one before it, so the numbers before ``lo`` are noticed, too.
    """
    number, held, at, parser, head = 0, b"", 0, None, None
    while True:
        data = f.read(CHUNK)
        held += data
        if head is None:
            found = _SHEET_DATA.search(held)
            if found and not found[1]:
                head = held[: found.end()]
            elif found or not data:
                return
            else:
                continue
        # The last tag may go on in the next chunk.
        end = max(held.rfind(b"<"), 0) if data else len(held)
        start, stop = 0, end
        for tag in _ROW_TAG.finditer(held, max(hi - at, 0) if parser else 0, end):
            place = at + tag.start()
            if place >= hi:
                stop = tag.start()
                break
            if place >= lo:
                parser, start = ElementTree.XMLPullParser(["end"]), tag.start()
                parser.feed(head)
                beyond = _ROW_TAG.search(held, max(hi - at, 0), end)
                stop = beyond.start() if beyond else end
                break
            given = _ROW_NUMBER.search(tag[0])
            number = int(given[1]) if given else number + 1
        if parser:
            parser.feed(held[start:stop])
            for _, node in parser.read_events():
                if node.tag == f"{_MAIN}row":
                    number = int(node.get("r", number + 1))
                    yield number, node
                    node.clear()
        if stop < end or not data:
            return
        held, at = held[end:], at + end


def _sheet_nodes(f: IO[bytes], span: tuple[int, int] | None) -> Iterator[tuple[int, ElementTree.Element]]:
    if span is None:
        number = 0
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{_MAIN}row":
                number = int(node.get("r", number + 1))
                yield number, node
                node.clear()
    else:
        yield from _row_nodes(f, *span)


def _rows(
    path: str, spec: SheetSpec, span: tuple[int, int] | None = None
) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number, {column number: text}) of the non-empty cells, streamed; of one part or of all."""
    with zipfile.ZipFile(path) as book:
        shared = _shared_texts(book)
        with book.open(_sheet_member(book, spec.sheet)) as f:
            for number, node in _sheet_nodes(f, span):
                cells, at = {}, 0
                for cell in node.findall(f"{_MAIN}c"):
                    at = _column_index(cell.get("r", "").rstrip("0123456789")) or at + 1
                    text = cell_text(_cell_value(cell, shared))
                    if text is not None and text != "":
                        cells[at] = text
                yield number, cells


def read_sheet_header(path: str, spec: SheetSpec) -> list[str]:
    """Header cells from the first column to the last non-blank one."""
    for number, cells in _rows(path, spec):
        if number >= spec.header_row:
            break
    else:
        raise ValueError(f"{path} ends before header row {spec.header_row}")
    filled = [c for c, t in cells.items() if c >= spec.start_col and t.strip()]
    if number != spec.header_row or not filled:
        raise ValueError(f"{path} has an empty header in row {spec.header_row}")
    return [cells.get(c, "") for c in range(spec.start_col, max(filled) + 1)]


def _data_rows(
    path: str, spec: SheetSpec, width: int, span: tuple[int, int] | None = None
) -> Iterator[tuple[int, list[str | None]]]:
    """(place below the header, values) of a part's first run of rows without an empty one between."""
    expected = spec.header_row + 1 if span is None else None
    for number, cells in _rows(path, spec, span):
        if number <= spec.header_row:
            continue
        values = [cells.get(c) for c in range(spec.start_col, spec.start_col + width)]
        filled = any(v is not None for v in values)
        if expected is None and not filled:
            continue
        if number != (expected or number) or not filled:
            return
        yield number - spec.header_row - 1, values
        expected = number + 1


def _workbooks(path: str) -> list[str]:
    """Workbooks of a folder, a glob or one path, in name order; executors must see the same."""
    path = path.removeprefix("file:")
    found = sorted(glob.glob(f"{path}/*.xlsx" if os.path.isdir(path) else path))
    if not found:
        raise ValueError(f"no workbook at {path}")
    return found


def _spans(path: str, spec: SheetSpec, split_bytes: int) -> list[tuple[int, int] | None]:
    """Byte ranges of the sheet for one task each, MOST_PARTS at most; None for a whole sheet.

    Sheets in other encodings than UTF-8 are not cut, since their tags cannot be found by bytes.
    """
    if os.path.getsize(path) * 32 <= split_bytes:
        return [None]
    with zipfile.ZipFile(path) as book:
        member = book.getinfo(_sheet_member(book, spec.sheet))
        if member.file_size <= split_bytes:
            return [None]
        with book.open(member) as f:
            start = f.read(200)
    named = re.match(rb"(?:\xef\xbb\xbf)?<\?xml[^>]*encoding\s*=\s*[\"']([^\"']*)", start)
    if start[:2] in (b"\xff\xfe", b"\xfe\xff") or named and named[1].lower() not in (b"utf-8", b"us-ascii"):
        return [None]
    width = max(split_bytes, -(-member.file_size // MOST_PARTS))
    return [(lo, lo + width) for lo in range(0, member.file_size, width)]


class _Part(InputPartition):
    def __init__(self, order: int, part: int, path: str, span: tuple[int, int] | None) -> None:
        self.order = order
        self.part = part
        self.path = path
        self.span = span


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], spec: SheetSpec, headers: list[str], split_bytes: int) -> None:
        self.paths = paths
        self.spec = spec
        self.headers = headers
        self.split_bytes = split_bytes

    def partitions(self) -> list[_Part]:
        return [
            _Part(order, part, path, span)
            for order, path in enumerate(self.paths)
            for part, span in enumerate(_spans(path, self.spec, self.split_bytes))
        ]

    def read(self, partition: _Part) -> Iterator[tuple]:
        # A workbook with another header would put values under the wrong names.
        if partition.part == 0 and read_sheet_header(partition.path, self.spec) != self.headers:
            raise ValueError(f"{partition.path} has another header than {self.paths[0]}")
        rows = _data_rows(partition.path, self.spec, len(self.headers), partition.span)
        for place, values in rows:
            yield (partition.order, partition.part, place, *values)


class WorkbookSource(DataSource):
    """``spark.read.format("ledger_workbook")``; all columns text, plus sheet order, part and row."""

    @classmethod
    def name(cls) -> str:
        return "ledger_workbook"

    def _spec(self) -> SheetSpec:
        o = self.options
        return SheetSpec(
            int(o.get("header_row", 1)), int(o.get("start_col", 1)), o.get("sheet") or None
        )

    def schema(self) -> str:
        headers = read_sheet_header(_workbooks(self.options["path"])[0], self._spec())
        names = unique_names(headers, self._spec().start_col - 1)
        return ", ".join(
            ["`_sheet` long", "`_part` long", "`_row` long", *[f"`{n}` string" for n in names]]
        )

    def reader(self, schema) -> _Reader:
        paths = _workbooks(self.options["path"])
        split_bytes = int(self.options.get("split_bytes", SPLIT_BYTES))
        return _Reader(paths, self._spec(), read_sheet_header(paths[0], self._spec()), split_bytes)


def _joined_runs(rows: DataFrame) -> DataFrame:
    """Rows of the parts whose run joins on to the header through all runs before it."""
    rows = materialize(rows, "sheet-rows")
    runs = rows.groupBy("_sheet", "_part").agg(F.min("_row").alias("_from"), F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("_sheet").orderBy("_part")
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = F.min(F.col("_from") == F.col("_before")).over(upto)
    kept = runs.withColumn("_before", before).withColumn("_joined", joined).filter("_joined")
    kept = materialize(kept.select("_sheet", "_part"), "sheet-runs")
    return rows.join(broadcast_if_small(kept), ["_sheet", "_part"], "left_semi")


def read_workbooks(
    spark: SparkSession,
    path: str,
    spec: SheetSpec = SheetSpec(),
    row_id: str = ROW_ID,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """One workbook, a folder of workbooks or a glob, as a ledger of text columns.

    Row ids number the rows of all sheets in file-name order. A sheet is shorter than 2**20 rows,
    so its place in the order leads the id. Rows of sheets that are read in several parts are written
    once, to find where each table ends.
    """
    paths = _workbooks(path)
    headers = read_sheet_header(paths[0], spec)
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format(WorkbookSource.name()).options(
        header_row=spec.header_row, start_col=spec.start_col, sheet=spec.sheet or "", split_bytes=split_bytes
    )
    df = reader.load(path)
    if any(_spans(p, spec, split_bytes) != [None] for p in paths):
        df = _joined_runs(df)
    return df.select(
        (F.shiftleft("_sheet", 20) + F.col("_row")).alias(row_id),
        *[
            F.col(n).alias(n, metadata={"source_name": h, "monetary": False})
            for n, h in zip(unique_names(headers, spec.start_col - 1), headers)
        ],
    )
