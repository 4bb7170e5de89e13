"""Repair of conversations at the least cost, by weighted interval parsing.

Roles must read ``(s?(ua)+)?``: an optional system turn, then user and assistant in turn. Each row may be
kept, given the other role or deleted, and empty turns may be inserted anywhere. The grammar of repairs
is in Chomsky normal form; its symbols are the kinds of pieces a right conversation can be cut into: the
empty piece, a lone system turn, and runs by their first and last role (a run of user and assistant may
begin and end with either, one with a system turn in front ends with either). A rule joins two kinds
that fit, as (user .. assistant) and (user .. user) do.

The cell of a span of rows has the cheapest edits for each symbol, as (cost, audit); the audit is the
initials of the edits in order. Cells of single rows are closed under insertion at both ends, then
spans of neighbours are joined bottom-up, doubling in length. Any cut of a span into two gives all its
derivations, since every piece of a repaired conversation has a symbol, so one cut per span is enough.
Of equal costs the audit that is least in ASCII order stays; two audits of one span and cost can't begin
with one another (a longer one has more insertions, which cost), so the least parts make the least whole.

Spark sorts narrow rows (without texts) into ranges of (conversation, turn), so that a conversation of
any length is spread over tasks; each task parses its part of a conversation into one cell, and the
cells of a conversation, at most one per task, are joined. The texts then stream past the audit, in
order, into the hash; a task holds one batch and one audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_lookup
from .common import small_batches, table, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: Symbols: the empty piece, a system turn, and runs by first and last role (s, u or a).
SYMBOLS = ("", "s", "uu", "ua", "au", "aa", "su", "sa")
#: Symbols of a whole conversation.
WHOLE = ("", "ua", "sa")

Cell = dict[str, tuple[int, str]]


def joined_symbol(left: str, right: str) -> str | None:
    """Symbol of two pieces in a row; None if they don't fit."""
    if not left or not right:
        return left or right
    if right[0] == "s" or (right[0] == "u") == (left[-1] == "u"):
        return None
    return left[0] + right[-1]


RULES = [(x, y, z) for x in SYMBOLS for y in SYMBOLS if (z := joined_symbol(x, y)) is not None]


def join(left: Cell, right: Cell) -> Cell:
    """Cell of a span from those of its two parts."""
    out: Cell = {}
    for x, y, z in RULES:
        if x in left and y in right:
            a, b = left[x], right[y]
            cost = a[0] + b[0]
            if z not in out or cost <= out[z][0]:
                made = (cost, a[1] + b[1])
                if z not in out or made < out[z]:
                    out[z] = made
    return out


#: Insertions alone: one or two turns, as no cheaper repair needs more between two rows.
INSERTED: Cell = {
    "": (0, ""),
    "uu": (INSERT, "I"),
    "aa": (INSERT, "I"),
    "ua": (2 * INSERT, "II"),
    "au": (2 * INSERT, "II"),
}


@lru_cache(None)
def row_cell(kind: str) -> Cell:
    """Cell of one row: ``d`` must go; else its role's initial, in capitals if it is truncated."""
    cell: Cell = {"": (DELETE, "D")}
    if kind != "d":
        extra = TRUNCATED if kind.isupper() else 0
        cell["uu"] = cell["aa"] = (REROLE + extra, "R")
        own = {"s": "s", "u": "uu", "a": "aa"}.get(kind.lower())
        if own:
            cell[own] = (KEEP + extra, "K")
    return join(join(INSERTED, cell), INSERTED)


def joined(cells: list[Cell]) -> Cell:
    """Cell of several neighbouring spans, bottom-up."""
    while len(cells) > 1:
        cells = [join(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else {"": (0, "")}


@lru_cache(100_000)
def _short(kinds: str) -> Cell:
    return joined([row_cell(k) for k in kinds])


def parse(kinds: str) -> Cell:
    """Cell of a span of rows, one letter for each (see ``row_cell``)."""
    return joined([_short(kinds[i : i + 8]) for i in range(0, len(kinds), 8)])


def best(cell: Cell) -> tuple[int, str]:
    """Cost and audit of the cheapest right conversation."""
    return min(cell[s] for s in WHOLE if s in cell)


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, while the rows are read."""
    rows, last = iter(rows), ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if last == "u" else "user"
        last = role[0]
        yield role, text


_WHITE = " \t\n\x0b\f\r"


def key_of(conv_id: Column) -> Column:
    """A conversation id as text that is never NULL; ``id_of`` takes it back."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def id_of(key: Column, kind: str) -> Column:
    return F.when(key != "", F.substring(key, 2, 2**31 - 1)).cast(kind)


def described(rows: DataFrame) -> DataFrame:
    """(key, turn, role, digest, text) of rows with conv_id, turn, role and text."""
    return rows.select(
        key_of(rows["conv_id"]).alias("key"),
        rows["turn"].cast("long").alias("turn"),
        F.coalesce(rows["role"], F.lit(" ")).alias("role"),
        F.coalesce(rows["text"], F.lit(" ")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


PIECE = (
    "key string, part int, first string, last string, low long, high long, turns long, blank long, "
    "duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"
)


def pieces(rows: DataFrame) -> DataFrame:
    """One cell for each part of a conversation that a task reads, with its counts and edges."""
    ended = F.rtrim("text", F.lit(_WHITE))
    narrow = rows.select(
        "key", "turn", "role", "digest", (ended == "").alias("blank"), (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("open")
    )
    items = narrow.groupBy("key", "turn", "role", "digest", "blank", "open").agg(F.count("*").alias("m"))
    firsts = items.groupBy("key", "role", "digest").agg(
        F.max(F.col("turn").isNull()).alias("at_null"), F.min("turn").alias("at")
    )
    items = join_lookup(items, firsts, ["key", "role", "digest"], how="inner")
    fresh = F.when(F.col("at_null"), F.col("turn").isNull()).otherwise(F.coalesce(F.col("turn") == F.col("at"), F.lit(False)))
    items = written(items.select("key", "turn", "role", "digest", "blank", "open", "m", fresh.alias("fresh")))

    def run(batches):
        part = TaskContext.get().partitionId()
        own: _Piece | None = None
        for batch in batches:
            out = []
            for key, turn, role, blank, open_, m, fresh in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None or own.key != key:
                    if own is not None:
                        out.append(own.row(part))
                    own = _Piece(key)
                own.add(turn, role, blank, open_, m, fresh)
            if out:
                yield _batch(out, PIECE)
        if own is not None:
            yield _batch([own.row(part)], PIECE)

    order = ["key", "turn", "role", "digest"]
    laid = items.repartitionByRange(*order).sortWithinPartitions(*order)
    return laid.select("key", "turn", "role", "blank", "open", "m", "fresh").mapInArrow(run, PIECE)


class _Piece:
    """The part of a conversation that a task reads, row by row."""

    def __init__(self, key: str):
        self.key = key
        self.kinds: list[str] = []
        self.first = self.last = ""
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, blank: bool, open_: bool, m: int, fresh: bool) -> None:
        """``m`` equal rows; only the first of them can be the first one of its role and text."""
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if self.last:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += m - 1  # no role may follow itself
        self.first, self.last = self.first or initial, initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if blank:
            self.blank += m
            self.kinds.append("d" * m)
        elif not fresh:
            self.duplicate += m
            self.kinds.append("d" * m)
        else:
            self.duplicate += m - 1
            self.truncated += open_
            self.kinds.append((initial.upper() if open_ else initial) + "d" * (m - 1))

    def row(self, part: int) -> tuple:
        cell = parse("".join(self.kinds))
        costs, audits = zip(*(cell.get(s, (None, None)) for s in SYMBOLS))
        return (
            self.key, part, self.first, self.last, self.low, self.high, self.turns, self.blank,
            self.duplicate, self.truncated, self.illegal, list(costs), list(audits),
        )


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


REPAIRED = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repairs(found: DataFrame) -> DataFrame:
    """Counts, cost and audit of every conversation, from its pieces."""

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            out = []
            for piece in batch.to_pylist():
                if held and held[-1]["key"] != piece["key"]:
                    out.append(whole(held))
                    held = []
                held.append(piece)
            if out:
                yield _batch(out, REPAIRED)
        if held:
            yield _batch([whole(held)], REPAIRED)

    def whole(held: list[dict]) -> tuple:
        illegal, turns, high = 0, 0, None
        lows = [p["low"] for p in held if p["low"] is not None]
        for i, p in enumerate(held):
            illegal += p["illegal"] + (i > 0 and held[i - 1]["last"] + p["first"] not in ("su", "ua", "au"))
            turns += p["turns"] - (p["low"] is not None and p["low"] == high)
            high = p["high"] if p["high"] is not None else high
        cells = [{s: (c, a) for s, c, a in zip(SYMBOLS, p["costs"], p["audits"]) if c is not None} for p in held]
        gaps = min(high - lows[0] + 1 - turns, 2**63 - 1) if lows else 0
        total = [sum(p[k] for p in held) for k in ("blank", "duplicate", "truncated")]
        return (held[0]["key"], gaps, *total, illegal, *best(joined(cells)))

    return found.repartition("key").sortWithinPartitions("key", "part").mapInArrow(run, REPAIRED)


def hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(key, repaired_sha256): the repaired rows as ``role:text``, joined by line breaks."""
    none = {"turn": "long", "role": "string", "digest": "binary", "text": "string"}
    heads = audits.select("key", F.lit(0).alias("seq"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "audit")
    lines = rows.select("key", F.lit(1).alias("seq"), *none, F.lit(None).cast("string").alias("audit"))

    def run(batches):
        stream = ((k, a, r, t) for batch in batches for k, a, r, t in zip(*(c.to_pylist() for c in batch.columns)))
        out = []
        head = next(stream, None)
        while head is not None:
            key, audit = head[:2]
            head = None

            def own():
                nonlocal head
                for k, a, r, t in stream:
                    if k != key:
                        head = (k, a, r, t)
                        return
                    yield r, t

            lines_of = own()
            digest, between = hashlib.sha256(), b""
            for role, text in edited(audit, lines_of):
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            for _ in lines_of:
                raise ValueError("a row has no edit")
            out.append((key, digest.hexdigest()))
            if len(out) >= 1000:
                yield _batch(out, "key string, repaired_sha256 string")
                out = []
        if out:
            yield _batch(out, "key string, repaired_sha256 string")

    order = ["key", "seq", "turn", "role", "digest"]
    laid = heads.unionByName(lines).repartition("key").sortWithinPartitions(*order)
    return laid.select("key", "audit", "role", "text").mapInArrow(run, "key string, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest repair and its hash for each conversation (conv_id, turn, role, text).

    Rows go by turn, NULL turns first; rows of one turn by role, then by the SHA-256 of the text, so equal
    rows are neighbours. A NULL role or text is one space, and a NULL conv_id a conversation of its own.
    Other columns are not looked at. An empty table gives no rows.
    """
    small_batches()
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = described(conversations)
    found = written(repairs(pieces(rows)))
    hashed = hashes(rows, found.select("key", "audit")).withColumnRenamed("key", "of")
    out = found.join(hashed, F.col("key") == F.col("of"))
    return out.select(
        id_of(F.col("key"), kind).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that the contract plants by crc32 of ``conv_id:turn`` (a NULL is one space)."""
    space = F.lit(" ")
    named = [F.coalesce(conversations[c].cast("string"), space) for c in ("conv_id", "turn")]
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce(conversations["role"], space).alias("role"),
        F.coalesce(conversations["text"], space).alias("text"),
        (F.crc32(F.concat_ws(":", *named).cast("binary")) % 20).alias("fault"),
    ).where("fault <> 0")
    fault = F.col("fault")
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of the damaged conversations; one without rows after the damage has zeros and no edits."""
    conversations = table(spark, sf_dir, "conversations")
    found = repair(damaged(conversations))
    all_ids = conversations.select(key_of(conversations["conv_id"]).alias("all_key"), F.col("conv_id").alias("original")).distinct()
    out = all_ids.join(found.withColumn("key", key_of(F.col("conv_id"))), F.col("all_key") == F.col("key"), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        F.col("original").alias("conv_id"),
        *zeros,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
