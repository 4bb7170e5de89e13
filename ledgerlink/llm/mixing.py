"""Mixing sources by a curriculum whose weights change over training.

Each source has a schedule: weights at some times from 0 (start of training) to 1 (its end), linear
in between. The integral of the schedule is the source's weight; weights share out the tokens of
the whole mix, up to ``cap`` times a source's size, and what a capped source can't take goes to the
others by weight. Up to time t a source has delivered ``target * W(t) / W(1)`` tokens, W being the
integral up to t. Documents of a source follow one another in an order drawn from their ids, again
and again; a document that starts at token x of that stream gets the time at which the delivered
tokens reach x, its training position.

What a document gives is read off its positions: those of its copies that come before the end of
training, and of the last one the words that do. The result is sorted by position in ranges.

Only one row per source reaches the driver. The place of a document in its source's stream comes
from sums over CELLS cells of the drawn order and a running sum within the cell, so a source with
any share of the rows is spread over that many groups.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, fresh, n_words, table, written

#: The cells of the drawn order are its first three hexadecimal digits.
CELLS = 16**3
#: Words taken from a source, at most, by its size.
CAP = 3
#: Sources that a mix may have; the driver holds a row for each.
MOST_SOURCES = 1_000_000

Schedule = Sequence[tuple[float, float]]


def integral(schedule: Schedule) -> float:
    """Area under a schedule, whose times rise from 0 to 1."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def schedules(n: int) -> list[Schedule]:
    """The contract's weights 1, 2, 3, repeating: level, rising and falling ones."""
    shapes = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 4.0), (0.5, 3.0), (1.0, 2.0)))
    return [shapes[i % 3] for i in range(n)]


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float = CAP) -> list[float]:
    """Tokens wanted of each source: by weight, none above ``cap`` times its size.

    With sources in the order of size by weight, those below the level reached are capped; the rest
    shares what they leave.
    """
    total, weight = float(sum(sizes)), float(sum(weights))
    out = [0.0] * len(sizes)
    left, level = total, 0.0
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    for at, i in enumerate(order):
        level = left / weight
        if cap * sizes[i] > level * weights[i]:
            for j in order[at:]:
                out[j] = level * weights[j]
            break
        out[i] = float(cap * sizes[i])
        left -= out[i]
        weight -= weights[i]
    return out


def drawn(doc_id: Column) -> Column:
    """Hexadecimal digits that put documents in an order of their own."""
    return F.md5(F.concat(F.lit("mix-"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def time_at(done: Column, schedule: Schedule) -> Column:
    """Time by which a share ``done`` (0 to 1) of the schedule's integral is reached."""
    whole = integral(schedule)
    out, before = F.lit(1.0), integral(schedule)
    for (t0, w0), (t1, w1) in reversed(list(zip(schedule, schedule[1:]))):
        area = (t1 - t0) * (w0 + w1) / 2
        before -= area
        y = F.greatest(done * whole - F.lit(before), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        # y = w0 s + slope s^2 / 2, solved for the time s within the piece in the stable form.
        s = 2 * y / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * y, F.lit(0.0))))
        out = F.when(done * whole < before + area, F.lit(t0) + F.coalesce(s, F.lit(0.0))).otherwise(out)
    return out


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, dict]:
    """``docs`` with what the mix needs, and the names of those columns."""
    own = dict(zip(("size", "order", "cell", "source"), fresh(docs, "size", "order", "cell", "mix_source")))
    # Sources as text that is never NULL, so that windows and joins by it share one layout.
    named = F.coalesce(F.concat(F.lit("="), col(docs, source)), F.lit(""))
    out = docs.withColumns({own["size"]: n_words(col(docs, text)), own["order"]: drawn(col(docs, doc_id)), own["source"]: named})
    return out.withColumn(own["cell"], F.substring(own["order"], 1, 3)), own | {"doc_id": doc_id, "text": text}


def mix(docs: DataFrame, own: dict, make: Callable[[int], list[Schedule]] = schedules, cap: float = CAP) -> tuple[DataFrame, dict]:
    """``docs`` (as ``measured`` gives it) with source_size, target, begin, taken, positions and position.

    ``begin`` counts the source's words before the document in one round of its stream; ``positions`` are
    the times at which the copies of the document begin, one for each round that begins in training,
    and ``position`` is that of the first (1 if training ends before). ``taken`` counts the words of those
    copies up to the target, so the sum over a source is its target in whole words and no document gives
    more than ``cap`` (rounded up) times its size. The names of the
    new columns avoid those of ``docs`` and come with the result. Sources are
    taken in the order of their names, NULL last; a source without words has target 0. An empty
    table gives no rows. Rows of the same doc_id are ordered by size and text; equal rows are alike.
    """
    spark = docs.sparkSession
    size, order, cell, source = (own[k] for k in ("size", "order", "cell", "source"))
    cells = written(docs.groupBy(source, cell).agg(F.sum(size).alias("n")))
    got = cells.groupBy(source).agg(F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(got) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    got = sorted(got, key=lambda r: (r[0] == "", r[0]))
    made = make(len(got))
    wanted = targets([r["n"] for r in got], [integral(s) for s in made], cap)
    kinds = list(dict.fromkeys(made))
    names = dict(zip(("s", "source_size", "target", "schedule", "c", "before"), fresh(docs, "of", "source_size", "target", "schedule", "in_cell", "before")))
    # As an Arrow table: rows would go through Python workers of another kind, beside those of all other steps.
    columns = [pa.array([r[0] for r in got], pa.string()), pa.array([r["n"] for r in got], pa.int64()), pa.array(wanted, pa.float64())]
    kind_of = pa.array([kinds.index(s) for s in made], pa.int32())
    plan = spark.createDataFrame(pa.Table.from_arrays([*columns, kind_of], names=[names[k] for k in ("s", "source_size", "target", "schedule")]))
    ahead = Window.partitionBy(source).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(
        F.col(source).alias(f"{names['s']}_"), F.col(cell).alias(names["c"]), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(names["before"])
    )
    starts = starts.join(plan, starts[f"{names['s']}_"] == plan[names["s"]]).drop(names["s"])
    ties = [c for c in (own["doc_id"], size, own["text"]) if c in docs.columns]
    within = Window.partitionBy(source, cell).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    (running, begin, taken, positions, position) = fresh(docs, "running", "begin", "taken", "positions", "position")
    out = docs.withColumn(running, F.coalesce(F.sum(size).over(within), F.lit(0)))
    out = out.join(starts, (out[source] == starts[f"{names['s']}_"]) & (out[cell] == starts[names["c"]]))
    out = out.withColumn(begin, F.col(running) + F.col(names["before"]))

    def begins_at(nth: Column) -> Column:
        """Time of the first word of the document in a round of its source's stream."""
        done = F.least(F.coalesce((nth * F.col(names["source_size"]) + F.col(begin)) / F.col(names["target"]), F.lit(0.0)), F.lit(1.0))
        at = F.lit(None).cast("double")
        for i, kind in enumerate(kinds):
            at = F.when(F.col(names["schedule"]) == i, time_at(done, kind)).otherwise(at)
        return at

    whole = F.round(names["target"]).cast("long")
    last = F.when(F.col(names["source_size"]) > 0, F.floor(whole / F.greatest(names["source_size"], F.lit(1)))).otherwise(0)
    # A handful of rounds, as the cap allows.
    times = F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), begins_at)
    out = out.withColumn(positions, F.filter(times, lambda t: t < 1.0)).withColumn(position, begins_at(F.lit(0)))
    place = F.col(begin) + (F.size(positions) - 1) * F.col(names["source_size"])  # where the last copy begins
    some = F.greatest(F.lit(0), F.least(F.col(size), whole - place))
    given = F.when(F.size(positions) == 0, 0).otherwise((F.size(positions) - 1) * F.col(size) + some)
    out = out.withColumn(taken, given.cast("long"))
    return out, {**names, "begin": begin, "taken": taken, "positions": positions, "position": position, "kinds": kinds}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and its training position; sorted by position.

    Rows of the same id are ordered by size. A NULL id counts as the empty text in the drawn order.
    """
    docs, own = measured(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    narrow = written(docs.drop("text"))
    mixed, n = mix(narrow, own)
    mixed = mixed.repartitionByRange(F.col(n["position"]), F.col(own["order"])).sortWithinPartitions(n["position"], own["order"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col(n["position"]).alias("position"))


def time_sql(done: str, schedule: Schedule) -> str:
    """The time by which a share of a schedule's integral is reached, piece by piece, in SQL."""
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        slope, area = (w1 - w0) / (t1 - t0), (t1 - t0) * (w0 + w1) / 2
        y = f"greatest({done} * {integral(schedule)}::double - {before}::double, 0::double)"
        root = f"sqrt(greatest({w0 * w0}::double + 2 * {slope}::double * {y}, 0::double))"
        out.append(f"when {done} * {integral(schedule)}::double < {before + area}::double then {t0}::double + 2 * {y} / ({w0}::double + {root})")
        before += area
    return f"case {' '.join(out)} else 1::double end"


#: The same in SQL. Sources in the order of cap by weight are capped up to the first that stays below.
OP7_SQL = rf"""
with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           md5('mix-' || coalesce(doc_id::varchar, '')) as place
    from documents
), summed as (
    select source, sum(size)::bigint as n from sized group by source
), weighed as (
    select *, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from summed
), ordered as (
    select *, 3.0::double * n / weight as until,
           row_number() over (order by 3.0::double * n / weight, source nulls last) as rank
    from weighed
), levelled as (
    select *, (sum(n) over () - coalesce(sum(3 * n) over (order by rank rows between unbounded preceding and 1 preceding), 0))::double
              / (sum(weight) over (order by rank rows between current row and unbounded following))::double as level
    from ordered
), first_free as (
    select min(rank) as rank from levelled where (3 * n)::double > level * weight
), planned as (
    select l.source, l.n, l.weight, case when f.rank is null or l.rank < f.rank then (3 * l.n)::double
                               else (select level from levelled where rank = f.rank) * l.weight end as target
    from levelled l cross join first_free f
), placed as (
    select s.doc_id, s.size, p.weight, p.n as source_size, p.target, round(p.target)::bigint as whole,
           coalesce(sum(s.size) over (partition by s.source order by place, doc_id rows between unbounded preceding and 1 preceding), 0) as begin
    from sized s join planned p on s.source is not distinct from p.source
)
select doc_id, size, source_size, target,
       case when source_size = 0 then 0
            else (whole // source_size) * size + greatest(0, least(size, whole % source_size - begin)) end::bigint as taken,
       case weight {" ".join(f"when {i + 1} then {time_sql('done', s)}" for i, s in enumerate(schedules(3)))} end as position
from (select *, least(coalesce(begin::double / nullif(target, 0), 0::double), 1::double) as done from placed)
"""


def training_order(docs: DataFrame, make: Callable[[int], list[Schedule]] = schedules, cap: float = CAP) -> DataFrame:
    """The mixed documents as rows of ``docs``, sorted by training position.

    A document appears once for each round of its source's stream that takes at least half of its
    words, whole each time, so at most ``cap`` times; a document without words appears once. The
    rows of the partitions in their order are the order of training.
    """
    ready, own = measured(docs)
    mixed, n = mix(ready, own, make, cap)
    size = F.col(own["size"])
    # Copies of which training takes at least half; they are the first ones.
    many = F.when(size > 0, F.floor((F.col(n["taken"]) + size / 2) / F.greatest(size, F.lit(1)))).otherwise(1).cast("int")
    times = F.slice(F.when(F.size(n["positions"]) > 0, F.col(n["positions"])).otherwise(F.array(F.col(n["position"]))), 1, many)
    (at,) = fresh(mixed, "at")
    copies = mixed.where(many > 0).select(*[col(mixed, c) for c in docs.columns], F.explode(times).alias(at), F.col(own["order"]))
    placed = copies.repartitionByRange(F.col(at), F.col(own["order"])).sortWithinPartitions(at, own["order"])
    return placed.select(*[col(placed, c) for c in docs.columns])
