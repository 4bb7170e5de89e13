"""Records of delimited text files, numbered in file order, read in splits.

A record is a line, unless a quoted field goes on behind the end of the line. A line that begins in a
split may lie inside quotes that were opened long before, so each line is looked at twice: what it
leaves behind if it begins outside of quotes, and what if it begins inside. Lines, blocks (splits) and
files compose: a line either settles the state, or keeps or flips it, so the state before a line is that
of the last line that settled it plus the flips since. One pass over the text yields a row per block;
running over the blocks of a file, these give the state and the number of records before each block.

Most blocks hold no line that opens a quote it does not close, and no blank line: their lines are their
records, and a line's number is its place in the block plus the block's offset. Only lines of other
blocks are sorted within their block, and only the lines of records that span lines are put together.
The rows of plain blocks are not moved at all; the table of blocks, one row for each split of input, is
broadcast if it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .spread import broadcast_if_small

_BLOCK = ["file", "block"]


def quote_states(line: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether a line ends inside quotes if it begins outside of them, and if it begins inside.

    A quote opens a field only at its start; elsewhere in an unquoted field it is an ordinary
    character. Inside quotes a doubled quote stands for one.
    """
    sep = "\\" + delimiter if delimiter in "|.*+?^$()[]{}\\" else delimiter
    quoted = '(?:[^"]|"")*+'

    def opened(text: Column) -> Column:
        return F.regexp_replace(text, f'(^|{sep})"{quoted}"(?={sep}|$)', "$1").rlike(f'(^|{sep})"{quoted}$')

    has_quote = line.contains('"')
    closes = line.rlike(f'^{quoted}"')
    rest = F.regexp_replace(line, f'^{quoted}"', "")
    return has_quote & opened(line), ~has_quote | ~closes | opened(F.concat(F.lit("."), rest))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the offset of their split and a number that rises within the split."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("line"),
    )


def _is_blank(line: Column) -> Column:
    return F.length(line) == 0


def _state(settled: Column, flips: Column) -> Column:
    return (settled + flips) % 2


def _busy_lines(lines: DataFrame, delimiter: str, header_row: int, header: str, path: str) -> DataFrame:
    """Lines of busy blocks with their row number, head of record and state for both states that the
    block may begin in (0 outside, 1 inside quotes). Lines up to the header are no rows."""
    in_block = Window.partitionBy(*_BLOCK).orderBy("id")
    upto = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    top = (F.col("block") == 0) & (F.col("nth") <= header_row)
    wrong = (F.col("block") == 0) & (F.col("nth") == header_row) & (F.regexp_replace("line", "^﻿", "") != header)
    out0, out1 = quote_states(F.col("line"), delimiter)
    df = lines.withColumn("nth", F.row_number().over(in_block))
    df = df.withColumn("top", F.when(wrong, _other_header(path)).otherwise(top))
    df = df.withColumns({"c0": F.when(F.col("top"), 0).otherwise(out0.cast("int")), "c1": F.when(F.col("top"), 0).otherwise(out1.cast("int"))})
    df = df.withColumn("flip", F.when((F.col("c0") == 1) & (F.col("c1") == 0), 1).otherwise(0))
    df = df.withColumns({"flips": F.sum("flip").over(upto)})
    df = df.withColumn("mark", F.when(F.col("c0") == F.col("c1"), _state(F.col("c0"), F.col("flips"))))
    df = df.withColumn("settled", F.last("mark", ignorenulls=True).over(before))
    for s in (0, 1):
        state = _state(F.coalesce("settled", F.lit(s)), F.col("flips") - F.col("flip"))
        row = (state == 0) & ~F.col("top") & ~_is_blank(F.col("line"))
        df = df.withColumns({f"state{s}": state, f"row{s}": row})
        head = F.when(F.col(f"row{s}") & (F.col("c0") == 1), F.col("id"))
        df = df.withColumns({f"rows{s}": F.count_if(f"row{s}").over(upto), f"head{s}": F.last(head, ignorenulls=True).over(upto)})
    return df


def _other_header(path: str) -> Column:
    return F.raise_error(F.lit(f"{path}: a file has another header than the first file")).cast("boolean")


def numbered_records(
    spark: SparkSession, path: str, delimiter: str, header_row: int, header: str
) -> DataFrame:
    """(at, line): the records below the headers, numbered from 0, files in name order.

    Every file must have the line ``header`` as its row ``header_row``. Blank lines between records are
    left out. A quote that is not closed by the end of its file is an error.
    """
    lines = _lines(spark, path)
    out0, out1 = quote_states(F.col("line"), delimiter)
    blocks = materialize(
        lines.groupBy(*_BLOCK).agg(
            F.min("id").alias("first"),
            F.count(F.lit(1)).alias("n"),
            (F.max(out0 | _is_blank(F.col("line"))) | ((F.col("block") == 0) & F.lit(header_row > 1))).alias("busy"),
            F.min(F.when(~out1, F.col("id"))).alias("closes_at"),
        ),
        "text-blocks",
    )
    short = blocks.filter((F.col("block") == 0) & (F.col("n") < header_row)).select("file").first()
    if short:
        raise ValueError(f"{short[0]} ends before header row {header_row}")
    busy = blocks.filter("busy").select(*_BLOCK)
    any_busy = not busy.isEmpty()
    skipped = F.when(F.col("block") == 0, header_row).otherwise(0)
    known = blocks.withColumns(
        {
            "flips": F.lit(0).cast("long"),
            "mark": F.when(F.col("closes_at").isNotNull(), 0),
            # Rows if the block begins outside of quotes, and inside.
            "rows0": F.col("n") - skipped,
            "rows1": F.coalesce(F.col("n") - (F.col("closes_at") - F.col("first") + 1), F.lit(0)),
            "head0": F.lit(None).cast("long"),
            "head1": F.lit(None).cast("long"),
        }
    )
    inside = None
    if any_busy:
        inside = materialize(
            _busy_lines(lines.join(broadcast_if_small(busy), _BLOCK), delimiter, header_row, header, path), "text-lines"
        )
        found = inside.groupBy(*_BLOCK).agg(
            F.sum("flip").alias("flips"),
            F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("id"))).alias("mark"),
            *[F.max(c).alias(c) for c in ("rows0", "rows1", "head0", "head1")],
        )
        names = found.columns[2:]
        known = known.join(found.withColumnsRenamed({c: f"own_{c}" for c in names}), _BLOCK, "left").withColumns(
            {c: F.when(F.col("busy"), F.col(f"own_{c}")).otherwise(F.col(c)) for c in names}
        )
    # A block's mark holds if it has one: the state then does not depend on what was before.
    along = Window.partitionBy("file").orderBy("block")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # Marks count the flips of their own block up to them; what follows them is the rest of its flips.
    end = F.when(F.col("mark").isNotNull(), _state(F.col("mark"), F.col("flips")))
    known = known.withColumns({"all_flips": F.sum("flips").over(upto), "end": end})
    known = known.withColumn("end_mark", F.when(F.col("end").isNotNull(), _state(F.col("end"), F.col("all_flips"))))
    start = _state(
        F.coalesce(F.last("end_mark", ignorenulls=True).over(before), F.lit(0)), F.col("all_flips") - F.col("flips")
    )
    known = known.withColumn("start", start)
    known = known.withColumns(
        {
            "rows": F.when(F.col("start") == 0, F.col("rows0")).otherwise(F.col("rows1")),
            "head": F.when(F.col("start") == 0, F.col("head0")).otherwise(F.col("head1")),
            "last": F.coalesce("end", _state(F.col("start"), F.col("flips"))),
        }
    )
    carried = F.last(F.when(F.col("head").isNotNull(), F.struct(F.col("block").alias("b"), F.col("head").alias("i"))), ignorenulls=True).over(before)
    known = known.withColumns(
        {
            "offset": F.coalesce(F.sum("rows").over(before), F.lit(0)),
            "carried": carried,
            "open": (F.lead("block").over(along).isNull()) & (F.col("last") == 1),
        }
    )
    known = materialize(known, "text-offsets")
    unclosed = known.filter("open").select("file").first()
    if unclosed:
        raise ValueError(f"{unclosed[0]} ends inside quotes")
    # One row per file.
    files = known.groupBy("file").agg(F.sum("rows").alias("rows"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("file_offset"))
    info = materialize(
        known.join(files, "file").select(
            *_BLOCK, "busy", "first", "start", "closes_at", "carried", (F.col("offset") + F.col("file_offset")).alias("offset")
        ),
        "text-starts",
    )

    plain_blocks = broadcast_if_small(info.filter("NOT busy").drop("busy", "carried").withColumn("known", F.lit(True)))
    # A split that the first pass did not see means that the session now cuts files in another way.
    located = lines.join(broadcast_if_small(info.select(*_BLOCK, "busy")), _BLOCK, "left") if any_busy else lines.withColumn("busy", F.lit(False))
    checked = located.filter(
        F.when(F.col("busy").isNotNull(), ~F.col("busy")).otherwise(
            F.raise_error(F.lit(f"{path}: files are cut in another way than when they were counted")).cast("boolean")
        )
    )
    rows = checked.drop("busy").join(plain_blocks, _BLOCK, "left")
    nth = F.col("id") - F.col("first")
    is_header = (F.col("block") == 0) & (nth == 0) & F.lit(header_row == 1)
    lost = F.raise_error(F.lit(f"{path}: files are cut in another way than when they were counted")).cast("boolean")
    kept = (
        F.when(F.col("known").isNull(), lost)
        .when(is_header & (F.regexp_replace("line", "^﻿", "") != header), _other_header(path))
        .otherwise(~is_header & ((F.col("start") == 0) | (F.col("id") > F.col("closes_at"))))
    )
    skip = F.when(F.col("start") == 1, F.col("closes_at") - F.col("first") + 1).when(F.col("block") == 0, 1).otherwise(0)
    out = rows.filter(F.coalesce(kept, F.lit(False))).select((F.col("offset") + nth - skip).alias("at"), "line")
    if not any_busy:
        return out

    starts = info.select(*_BLOCK, "start", "carried", "offset")
    mine = inside.join(broadcast_if_small(starts), _BLOCK)

    def by_state(name: str) -> Column:
        return F.when(F.col("start") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    mine = mine.select(
        *_BLOCK, "id", "line", "carried", by_state("row").alias("row"), by_state("state").alias("state"), by_state("head").alias("head"),
        (F.col("offset") + by_state("rows") - 1).alias("at"), ((by_state("row")) & (F.col("c0") == 1)).alias("opens"),
    )
    single = mine.filter("row AND NOT opens").select("at", "line")
    own = F.when(F.col("head").isNotNull(), F.struct(F.col("block").alias("b"), F.col("head").alias("i")))
    parts = mine.filter("opens OR state = 1").select(
        "file", F.coalesce(own, F.col("carried")).alias("of"), *_BLOCK[1:], "id", "line", F.when(F.col("opens"), F.col("at")).alias("at")
    )
    continued = info.filter("NOT busy AND start = 1").select(*_BLOCK, "closes_at", "carried")
    if not continued.isEmpty():
        tail = lines.join(broadcast_if_small(continued), _BLOCK).filter("closes_at IS NULL OR id <= closes_at")
        parts = parts.unionByName(
            tail.select("file", F.col("carried").alias("of"), "block", "id", "line", F.lit(None).cast("long").alias("at"))
        )
    whole = parts.groupBy("file", "of").agg(
        F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("block", "id", "line"))).alias("lines")  # one record
    )
    joined = whole.select("at", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("line"))
    return out.unionByName(single).unionByName(joined)
