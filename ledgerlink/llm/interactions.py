"""Audit of how document filters interact, by count-weighted decision diagrams.

A document's *failure mask* tells which filters it fails. Per part (source), a diagram maps masks to
weights: documents, good ones and toxic ones. Its levels are the filters in one order; a node has a
child for documents that pass its filter and one for those that fail it, and carries the summed weight
of all masks below. Equal nodes of a level are one node. Two adjacent levels are swapped by dealing
the four grandchildren of each upper node anew; nodes above and below stay as they are. Swaps lead
through all orders, and the path of passed filters from the root gives the steps of each order: what
a step keeps is the weight of the node it leads to, what it removes that of the failing child.

Spark counts the masks. Repeated texts are found by a hash of the whole text (SHA-256, so two texts
are taken for one with a probability below 1e-50 at any size of table); rows are added up by (hash,
part, mask) in each task before they are dealt out, so a text with very many copies is one row per
part and task. A diagram sees at most one row per mask of its part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

#: The filters by letter; a set bit of a mask, A the lowest, is a failed filter.
LETTERS = "ABCDE"

RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


class Node:
    """Weight below, and the children of documents that pass and that fail the filter of the level."""

    __slots__ = ("passed", "failed", "weight")

    def __init__(self, passed: Node | None, failed: Node | None, weight: tuple[int, ...]):
        self.passed, self.failed, self.weight = passed, failed, weight


class Diagram:
    """Weights of all masks of ``len(order)`` filters; level k decides by filter ``order[k]``."""

    def __init__(self, weights: dict[int, tuple[int, ...]], n: int, zero: tuple[int, ...]):
        self.order = list(range(n))
        self._levels: list[dict] = [{} for _ in range(n)]
        ends: dict[tuple, Node] = {}

        def build(level: int, mask: int) -> Node:
            if level == n:
                weight = weights.get(mask, zero)
                return ends.setdefault(weight, Node(None, None, weight))
            return self._node(level, build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _node(self, level: int, passed: Node, failed: Node) -> Node:
        known = self._levels[level]
        key = (id(passed), id(failed))
        if key not in known:
            known[key] = Node(passed, failed, tuple(x + y for x, y in zip(passed.weight, failed.weight)))
        return known[key]

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the next one."""
        upper = list(self._levels[level].values())
        self._levels[level], self._levels[level + 1] = {}, {}
        for node in upper:
            p, f = node.passed, node.failed
            node.passed = self._node(level + 1, p.passed, f.passed)
            node.failed = self._node(level + 1, p.failed, f.failed)
            self._levels[level][id(node.passed), id(node.failed)] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """(weight kept, weight removed) of each filter in turn: the path of passed filters."""
        out, node = [], self.root
        for _ in self.order:
            out.append((node.passed.weight, node.failed.weight))
            node = node.passed
        return out


def swaps_through_all_orders(n: int) -> Iterator[int]:
    """Levels to swap with the next one, one after another, to meet every order of n filters once.

    The last item walks through the orders of the others, once in each direction in turn; between
    two walks the others make one step of their own.
    """
    if n < 2:
        return
    inner = list(swaps_through_all_orders(n - 1))
    down = list(range(n - 2, -1, -1))
    walk = down
    yield from walk
    for step in inner:
        at_front = walk is down
        yield step + 1 if at_front else step
        walk = down[::-1] if at_front else down
        yield from walk


def audit_part(weights: dict[int, tuple[int, int, int]], letters: str = LETTERS) -> list[tuple]:
    """Rows of ``RESULT`` without the part, for the weights (documents, good, toxic) of its masks."""
    n = len(letters)
    diagram = Diagram(weights, n, (0, 0, 0))
    paths = [(tuple(diagram.order), diagram.steps())]
    for level in swaps_through_all_orders(n):
        diagram.swap(level)
        paths.append((tuple(diagram.order), diagram.steps()))
    fails, alone, total = [0] * n, [0] * n, [0] * n
    for order, steps in paths:
        fails[order[0]] = steps[0][1][0]  # the first filter removes all that fail it
        alone[order[-1]] = steps[-1][1][0]  # the last one those that fail no other
        for f, (_, removed) in zip(order, steps):
            total[f] += removed[0]
    return [
        ("".join(letters[f] for f in order), k, kept[0], gone[0], fails[f] - gone[0], alone[f], gone[1], gone[2], total[f])
        for order, steps in paths
        for k, (f, (kept, gone)) in enumerate(zip(order, steps), 1)
    ]


def own_failures(text: Column) -> list[Column]:
    """Failures that the text alone decides, A to D; ``text`` is not NULL."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals > 2 * F.char_length(text),
        text.rlike("[#$%&*|]"),
    ]


def mask_of(failures: Sequence[Column]) -> Column:
    out = F.lit(0)
    for i, failed in enumerate(failures):
        out = out + F.when(failed, 1 << i).otherwise(0)
    return out.cast("int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents with that failure mask, those of them with quality 1
    and with toxic 1.

    ``docs`` has doc_id, text and source; ``labels`` doc_id, quality and toxic. A NULL text is empty, a NULL
    source the part of the empty text. Rows are counted one by one, so repeated rows count each and
    none of them repeats the text of its own id. A row without an id repeats nothing and is repeated by
    nothing. Of several labels of one id, one with the value is enough.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    seen = docs.select(
        docs["doc_id"].cast("long").alias("doc"),
        F.coalesce(docs["source"], F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("copy_of"),
        mask_of(own_failures(text)).alias("mask"),
    )
    marked = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("labelled"))
        .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    )
    known = seen.join(marked, F.col("doc") == F.col("labelled"), "left")
    weights = {"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))}
    rows = known.select("doc", "part", "copy_of", "mask", *[c.alias(k) for k, c in weights.items()])
    rows = rows.groupBy("doc", "part", "copy_of", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    counts = {"n": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    first = F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", *[c.alias(k) for k, c in counts.items()])))
    texts = rows.groupBy("copy_of", "part", "mask").agg(
        first.alias("first"),
        *[F.sum(c).alias(k) for k, c in counts.items()],
        *[F.sum(F.when(F.col("doc").isNull(), c).otherwise(0)).alias(f"{k}_without_id") for k, c in counts.items()],
    )
    lowest = F.min("first.doc").over(Window.partitionBy("copy_of"))
    texts = texts.withColumn("lowest", lowest)
    # The rows of the lowest id and those without an id don't fail E; all others do.
    original = F.coalesce(F.col("first.doc") == F.col("lowest"), F.lit(False))
    passing = {k: F.when(original, F.col(f"first.{k}")).otherwise(0) + F.col(f"{k}_without_id") for k in counts}
    both = texts.groupBy("part", "mask").agg(
        *[F.sum(passing[k]).alias(f"{k}_pass") for k in counts], *[F.sum(F.col(k) - passing[k]).alias(f"{k}_fail") for k in counts]
    )
    repeated = 1 << len(LETTERS) - 1
    return both.select(
        "part",
        F.inline(
            F.array(
                F.struct(F.col("mask").alias("mask"), *[F.col(f"{k}_pass").alias(k) for k in counts]),
                F.struct((F.col("mask") + repeated).alias("mask"), *[F.col(f"{k}_fail").alias(k) for k in counts]),
            )
        ),
    ).where("n > 0")


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Steps of all orders of the filters, for each part of ``counted`` (as ``masks`` gives it)."""
    of_part = counted.groupBy("part").agg(
        F.collect_list(F.struct(F.col("mask").alias("mask"), "n", "good", "toxic")).alias("masks")  # 2 ** len(letters) at most
    )

    def run(batches):
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = audit_part({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in found}, letters)
                order, *numbers = zip(*rows)
                step, *counts = (np.array(x) for x in numbers)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows)), pa.array(order), pa.array(step, pa.int32()), *[pa.array(c, pa.int64()) for c in counts]],
                    names=[f.split()[0] for f in RESULT.split(", ")],
                )

    return of_part.mapInArrow(run, RESULT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of all 120 orders of the five filters, for every source.

    An empty table gives no rows. NULL and repeated ids, texts and sources are counted as ``masks`` says.
    """
    return audit(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


#: The same in SQL: each mask is sent through each order.
OP11_SQL = r"""
with texts as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
    from documents
), failed as (
    select part,
           if(len(w) < 200, 'A', '') || if(100 * len(list_distinct(w)) < 50 * len(w), 'B', '')
           || if(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), 'C', '')
           || if(regexp_matches(t, '[#$%&*|]'), 'D', '')
           || if(coalesce(doc_id > min(doc_id) over (partition by t), false), 'E', '') as f,
           doc_id in (select l.doc_id from labels l where l.quality = 1 and l.doc_id is not null) as good,
           doc_id in (select l.doc_id from labels l where l.toxic = 1 and l.doc_id is not null) as toxic
    from texts
), masks as (
    select part, f, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
    from failed group by part, f
), letters as (
    select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
    select a.x || b.x || c.x || d.x || e.x as filter_order
    from letters a, letters b, letters c, letters d, letters e
    where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x
), sent as (
    select m.*, filter_order, step, substr(filter_order, step, 1) as x,
           contains(f, substr(filter_order, step, 1)) as fails,
           translate(substr(filter_order, 1, step - 1), f, '') <> substr(filter_order, 1, step - 1) as gone
    from masks m, orders, (select unnest(range(1, 6))::int as step)
), steps as (
    select part, filter_order, step, x,
           coalesce(sum(n) filter (not gone and not fails), 0) as kept,
           coalesce(sum(n) filter (not gone and fails), 0) as removed,
           coalesce(sum(n) filter (gone and fails), 0) as redundant,
           coalesce(sum(n) filter (f = x), 0) as unique_fails,
           coalesce(sum(good) filter (not gone and fails), 0) as good_lost,
           coalesce(sum(toxic) filter (not gone and fails), 0) as toxic_lost
    from sent group by part, filter_order, step, x
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, x))::bigint as shapley
from steps
"""
