import math
import random

import numpy as np
import pandas as pd
import pytest

from ledgerlink.model import ReversalConfig
from ledgerlink.operators import chunks, reversal, tallies
from ledgerlink.operators.joins import join_lookup
from ledgerlink.operators.pairing import pair_in_row_order
from ledgerlink.operators.reversal import reversal_marks
from ledgerlink.sources import spread

PAIRED = ("01_Conciliado", "Conciliado_Estorno")
LEFT_OVER = ("04_Não Avaliado", "Documentos estornados")


def cents(x):
    return math.floor(x * 100 + 0.5)


def expected_marks(rows, limit):
    """The rule, one row at a time: rows are (row id, document, reference, amount)."""
    by_doc, by_ref = {}, {}
    for row, doc, ref, amount in rows:
        if doc:
            by_doc.setdefault(doc, []).append([row, amount, False])
        if ref:
            by_ref.setdefault(ref, []).append([row, amount, False])
    good, bad = set(), set()
    for key in by_doc.keys() & by_ref.keys():
        candidates = sorted(by_ref[key], key=lambda e: (cents(e[1]), e[0]))
        for entry in by_doc[key]:
            for c in candidates:
                if not c[2] and c[0] != entry[0] and abs(entry[1] + c[1]) <= limit:
                    entry[2] = c[2] = True
                    break
        for row, _, paired in by_doc[key] + by_ref[key]:
            (good if paired else bad).add(row)
    return {**dict.fromkeys(bad, LEFT_OVER), **dict.fromkeys(good, PAIRED)}


def marks_of(df, cfg, **options):
    return {
        r["row_id"]: (r["status"], r["grupo"])
        for r in reversal_marks(df, cfg, **options).collect()
    }


@pytest.mark.parametrize(
    "amount, limit, status",
    [("-1000", 0.0, PAIRED), ("-700", 0.0, LEFT_OVER), ("-1000,4", 0.5, PAIRED)],
)
def test_document_and_its_reference(table, amount, limit, status):
    df = table(["doc", "ref", "valor"], [("D1", "", "1000"), ("", "D1", amount), ("D2", "", "5")])
    assert marks_of(df, ReversalConfig("doc", "ref", "valor", limit)) == {0: status, 1: status}


def test_pairing_helper_follows_the_rule():
    rng = random.Random(5)
    for _ in range(600):
        limit = rng.choice([0.0, 0.3, 0.5, 1.0])
        step = rng.choice([0.25, 0.004, 1.0])
        rows, entries, groups = [], [], []
        for i in range(rng.randint(1, 60)):
            key = rng.choice("abc")
            doc, ref = rng.choice([(key, ""), ("", key), (key, key)])
            amount = rng.randint(-3, 3) * step
            rows.append((i, doc, ref, amount))
            if doc:
                entries.append(("A", amount, 0, i))
                groups.append("abc".index(doc))
            if ref:
                entries.append(("B", -amount, cents(amount), i))
                groups.append("abc".index(ref))
        frame = pd.DataFrame(entries, columns=["role", "m", "cents", "row_id"])
        flags = pair_in_row_order(frame, np.array(groups, dtype=np.int64), limit)
        got = {e[3] for e, f in zip(entries, flags) if f}
        want = {k for k, v in expected_marks(rows, limit).items() if v == PAIRED}
        assert got == want, (rows, limit)


def test_components_cut_by_batches(spark):
    """Batches of a few rows: components wait for their last row."""
    rng = random.Random(3)
    rows = random_ledger(rng, 60, 0.25, 9, 40)
    df = spark.createDataFrame(
        [(r, d, k, repr(v)) for r, d, k, v in rows],
        "row_id long, doc string, ref string, valor string",
    )
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert marks_of(df, ReversalConfig("doc", "ref", "valor", 0.5)) == expected_marks(rows, 0.5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def random_ledger(rng, tables, step, spread, size):
    """Many small tables in one: each has keys of its own, so they do not meet."""
    rows = []
    for t in range(tables):
        keys = [f"{t}/x", f"{t}/y"][: rng.randint(1, 2)]
        for _ in range(rng.randint(2, size)):
            doc = rng.choice([*keys, ""])
            ref = doc if rng.random() < 0.3 else rng.choice([*keys, ""])
            rows.append((len(rows), doc, ref, rng.randint(-spread, spread) * step))
    return rows


@pytest.mark.parametrize(
    "limit, step, spread, size, max_component",
    [
        (0.0, 0.25, 2, 14, 1000),  # equal amounts, many rows that meet themselves at zero
        (0.0, 1.0, 0, 9, 1000),  # zero amounts only
        (0.5, 0.25, 1, 12, 1000),  # components as narrow as the tolerance
        (0.5, 0.25, 9, 30, 1000),  # chains, in one task
        (0.5, 0.25, 9, 30, 3),  # the same chains, chunk by chunk
        (0.02, 0.004, 12, 40, 5),  # several amounts inside one cent
        (0.05, 0.01, 60, 90, 8),
        (40.0, 17.3, 300, 60, 25),  # amounts over several cells of the amount axis
    ],
)
def test_random_ledgers(spark, limit, step, spread, size, max_component):
    rng = random.Random(f"{limit}/{step}/{spread}/{max_component}")
    rows = random_ledger(rng, 120 if size < 60 else 30, step, spread, size)
    df = spark.createDataFrame(
        [(r, d, k, repr(v)) for r, d, k, v in rows],
        "row_id long, doc string, ref string, valor string",
    )
    got = marks_of(
        df,
        ReversalConfig("doc", "ref", "valor", limit),
        max_component=max_component,
        max_amounts=7 if max_component < 100 else 10**6,
        cell_bits=2,
    )
    assert got == expected_marks(rows, limit)


def wide_ledger(rng, keys, size, amounts, step, start=0):
    """Keys whose few amounts follow one another closer than the tolerance, each with many rows."""
    rows = []
    for k in range(keys):
        for _ in range(size):
            doc, ref = (f"w{k}", "") if rng.random() < 0.55 else ("", f"w{k}")
            rows.append((start + 7 * len(rows) + rng.randint(0, 6), doc, ref, (rng.randint(0, amounts) * step) * (1 if doc else -1)))
    return rows


def ledger_of(spark, rows):
    return spark.createDataFrame(
        [(r, d, k, repr(v)) for r, d, k, v in rows], "row_id long, doc string, ref string, valor string"
    )


@pytest.mark.parametrize("first_bits, step_bits, limit, step", [(2, 1, 0.5, 0.25), (3, 3, 1.0, 0.5), (4, 2, 0.3, 0.25), (10, 6, 2.5, 0.5)])
def test_counts_per_amount_and_block(spark, monkeypatch, first_bits, step_bits, limit, step):
    monkeypatch.setattr(tallies, "FIRST_BITS", first_bits)
    monkeypatch.setattr(tallies, "STEP_BITS", step_bits)
    taken = []
    plain = tallies.pair_by_counts
    monkeypatch.setattr(reversal, "pair_by_counts", lambda *a: taken.append(a) or plain(*a))
    rows = wide_ledger(random.Random(f"{first_bits}{limit}"), 12, 150, 9, step, start=-700)
    got = marks_of(ledger_of(spark, rows), ReversalConfig("doc", "ref", "valor", limit), max_component=4, dense=1, cell_bits=3)
    assert taken and got == expected_marks(rows, limit)


def test_blocks_of_rows_settle_a_component_as_the_rows_do():
    rng = random.Random(8)
    for _ in range(300):
        limit, step, amounts = rng.choice([0.3, 0.5, 1.0, 2.0]), rng.choice([0.25, 0.5]), rng.randint(1, 8)
        b = sorted(rng.randint(0, amounts) * step for _ in range(rng.randint(0, 30)))
        a = [(r, -rng.randint(0, amounts) * step) for r in sorted(rng.sample(range(256), 40))]
        free, want = list(b), {}
        for r, m in a:
            spot = next((v for v in free if abs(v + m) <= limit), None)
            want[r] = spot is not None
            if spot is not None:
                free.remove(spot)
        size = dict.fromkeys({r >> 6 << 6 for r, _ in a}, 6)
        while True:
            values = sorted(set(b))
            spots = tallies.Spots(values, [b.count(v) for v in values], limit)
            for start in sorted(size):
                inside = [m for r, m in a if r >> size[start] << size[start] == start]
                spots.block(start, size[start] == 0, [(m, inside.count(m)) for m in set(inside)])
            if not spots.doubtful:
                break
            for start in spots.doubtful:
                bits = size.pop(start)
                size |= {r >> bits - 2 << bits - 2: bits - 2 for r, _ in a if r >> bits << bits == start}
        assert {r: m not in spots.silent or r < spots.silent[m] for r, m in a} == want
        assert spots.taken() == [b.count(v) - free.count(v) for v in values]


def test_no_task_reads_a_hot_amount_range_whole(spark, monkeypatch):
    """A task sees counts per amount and block only: far fewer rows than entries."""
    seen = []
    plain = tallies._walk
    monkeypatch.setattr(tallies, "_walk", lambda spots, counted, limit: seen.append(spots.count() + counted.count()) or plain(spots, counted, limit))
    rng = random.Random(4)
    rows = [(i, "H", "", float(rng.randint(0, 3))) if i % 2 else (i, "", "H", -float(rng.randint(0, 3))) for i in range(40_000)]
    rows = [(i, d, r, v * 0.5) for i, d, r, v in rows]
    monkeypatch.setattr(tallies, "FIRST_BITS", 6)
    out = marks_of(ledger_of(spark, rows), ReversalConfig("doc", "ref", "valor", 1.0), max_component=1000)
    assert len(out) == 40_000 and max(seen) < 4000


def test_influence_runs_through_500_chunks_in_few_rounds(spark, monkeypatch):
    """Each entry of A takes the partner of the next one, so the first one decides about the last."""
    n, rounds = 1000, []
    plain = chunks._pair_runs
    monkeypatch.setattr(chunks, "_pair_runs", lambda state, limit, level: rounds.append(level) or plain(state, limit, level))
    rows = [(i, "K", "", float(i)) for i in range(n)] + [(n + i, "", "K", -float(i) - 0.5) for i in range(n)]
    rows.append((-1, "K", "", 0.25))
    rows.sort()
    got = marks_of(ledger_of(spark, rows), ReversalConfig("doc", "ref", "valor", 0.5), max_component=4, dense=10**6, cell_bits=6)
    assert got == expected_marks(rows, 0.5)
    assert len(rounds) <= 12


def test_one_key_holds_most_rows(spark):
    """A hot document key with few amounts, settled from ranks over many cells."""
    rng = random.Random(11)
    rows = [
        (i, "HOT" if rng.random() < 0.6 else f"d{i}", "HOT" if rng.random() < 0.3 else "",
         float(rng.randint(-3, 3)))
        for i in range(4000)
    ]
    df = spark.createDataFrame(
        [(r, d, k, str(v)) for r, d, k, v in rows],
        "row_id long, doc string, ref string, valor string",
    )
    for limit in (0.0, 0.5):
        got = marks_of(df, ReversalConfig("doc", "ref", "valor", limit), cell_bits=5)
        assert got == expected_marks(rows, limit)


def test_negative_limit_is_refused():
    with pytest.raises(ValueError):
        ReversalConfig("a", "b", "v", -1)


def zero_sum_plain(rows, limit):
    groups = {}
    for row, doc, ref, amount in rows:
        for key, role in ((doc, "doc"), (ref, "ref")):
            if key:
                members, roles = groups.setdefault(key, ({}, set()))
                members[row] = round(amount * 10**6)
                roles.add(role)
    good, bad = set(), set()
    for members, roles in groups.values():
        if len(roles) == 2 and len(members) > 1:
            (good if abs(sum(members.values())) <= limit * 10**6 else bad).update(members)
    return {**dict.fromkeys(bad, LEFT_OVER), **dict.fromkeys(good, PAIRED)}


@pytest.mark.parametrize("limit", [0.0, 0.25])
def test_zero_sum_groups(spark, limit):
    rng = random.Random(7)
    keys = [None, "", *"abcdefghijklmnop"]
    rows = [
        (i, rng.choice(keys), rng.choice(keys), rng.choice([-0.3, -0.1, 0.0, 0.1, 0.2, 0.25]))
        for i in range(120)
    ]
    rows += [(200, "own", "own", 0.0), (201, "one", "two", 0.0), (202, "x", "x", 5.0), (203, "", "x", -5.0)]
    rows += [(300 + i, "big", "", 0.1) for i in range(1000)] + [(2000, "", "big", -100.0)]
    df = spark.createDataFrame(rows, "row_id long, doc string, ref string, valor double").repartition(4)
    marks = reversal_marks(df, ReversalConfig("doc", "ref", "valor", limit, zero_sum_groups=True))
    got = {r["row_id"]: (r["status"], r["grupo"]) for r in marks.collect()}
    assert got == zero_sum_plain(rows, limit)
    assert got[2000] == got[202] == PAIRED and 200 not in got
    assert reversal_marks(df.limit(0), ReversalConfig("doc", "ref", "valor", zero_sum_groups=True)).count() == 0


def test_only_components_over_several_cells_are_joined(spark, monkeypatch):
    """Cells are 1000 wide here; what lies in one cell is added up there and not dealt out again."""
    joined = []

    def join(rows, *args, **options):
        joined.append(rows.count())
        return join_lookup(rows, *args, **options)

    monkeypatch.setattr(reversal, "join_lookup", join)
    rows = [
        ("K", 0.0, 1, 1, 0), ("K", 500.0, 2, 0, 1), ("K", 505.0, 0, 3, 0), ("K", 512.0, 1, 0, 0),
        ("K", 999.999, 1, 1, 0), ("K", 1000.001, 2, 2, 1), ("K", 1008.0, 4, 0, 0), ("K", 1500.0, 0, 1, 0),
        ("K", 2999.0, 1, 0, 0), ("K", 3001.0, 0, 1, 0), ("L", -1.0, 1, 0, 0), ("L", 1.0, 0, 1, 0), ("L", 2100.0, 1, 1, 0),
    ]
    amounts = spark.createDataFrame(rows, "key string, m double, na long, nb long, nd long").repartition(5)
    got = reversal._components_in_cells(amounts, 10.0)
    assert joined == [7]
    asked = ["key", "m", "comp", "na", "nb", "nd", "amounts", "clash", "narrow"]
    cells = {tuple(r) for r in got.select(asked).collect()}
    assert cells == {tuple(r) for r in reversal._components_in_key(amounts, 10.0).select(asked).collect()}
    assert ("K", 1008.0, 999.999, 7, 3, 1, 3, True, True) in cells and ("K", 500.0, 500.0, 3, 3, 1, 3, False, False) in cells


def test_tasks_do_not_grow_with_the_ledger(spark, monkeypatch):
    """Rows of a task are bounded by the bytes it reads, and there are partitions enough for that."""
    size, count = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k, None) for k in (size, count)}
    monkeypatch.setattr(spread, "NARROW_BYTES", 4000)
    try:
        spark.conf.unset(size)
        spark.conf.set(count, "4")
        rows = [(n, f"D{n % 50}" if n % 2 else "", "" if n % 2 else f"D{n % 50 + 1}", str(n * 7 % 90 if n % 2 else -(n * 7 % 90))) for n in range(2000)]
        df = spark.createDataFrame(rows, "row_id long, doc string, ref string, valor string")
        assert reversal_marks(df, ReversalConfig("doc", "ref", "valor", 3.0)).count() == 2000
        assert (spark.conf.get(size), spark.conf.get(count)) == ("4000", "20")
        spark.conf.set(size, "64MB")
        spark.conf.set(count, "30")
        spread.narrow_tasks(spark, 8000)
        assert (spark.conf.get(size), spark.conf.get(count)) == ("64MB", "30")  # larger numbers and given sizes stay
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
