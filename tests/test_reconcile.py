import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlink.model import CancelConfig, GroupConfig, KeyDef, RowConfig, build_keys
from ledgerlink.operators.cancel import cancel_marks
from ledgerlink.operators.groups import reconcile_groups
from ledgerlink.operators.multikey import reconcile_rows
from ledgerlink.operators.results import counts_by

DONE = ("01_Conciliado", "Conciliado")
NEAR = ("02_Encontrado c/Diferença", "Diferença Imaterial")
A_MORE = ("02_Encontrado c/Diferença", "Encontrado com diferença, BASE A MAIOR")
B_MORE = ("02_Encontrado c/Diferença", "Encontrado com diferença, BASE B MAIOR")
ABSENT = ("03_Não Encontrado", "Não encontrado")

CASES = [
    (1000, 1000, False, 0, DONE),
    (2000, 1000, False, 0, A_MORE),
    (1000, 2000, False, 0, B_MORE),
    (1010, 1000, False, 50, NEAR),
    (1050, 1000, False, 50, NEAR),
    (1050.01, 1000, False, 50, A_MORE),
    (1000, -1000, True, 0, DONE),
    (1000.0000005, 1000, False, 0, DONE),
    (12345.67, 12300, False, 100, NEAR),
    (1000.5, 1000, False, 0, A_MORE),
]


def six(x):
    return float(Decimal(repr(float(x))).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def judge(sa, sb, limit):
    d = six(sa - sb)
    if abs(d) <= 1e-6:
        return DONE
    if limit > 0 and abs(d) <= max(limit, 1e-6):
        return NEAR
    return A_MORE if d > 0 else B_MORE


def group_result(a, b, invert=False, limit=0.0, cols=("chave",)):
    cfg = GroupConfig(cols, cols, "valor", "valor", invert, limit)
    return {r["chave"]: r for r in reconcile_groups(a, b, cfg).collect()}


@pytest.mark.parametrize("sa, sb, invert, limit, expected", CASES)
def test_classification(table, sa, sb, invert, limit, expected):
    a = table(["chave", "valor"], [("K", str(sa))])
    b = table(["chave", "valor"], [("K", str(sb))])
    r = group_result(a, b, invert, limit)["K"]
    assert (r["status"], r["grupo"]) == expected
    assert r["soma_b"] == (-sb if invert else sb)


def test_five_scenarios(table):
    a = table(
        ["chave", "valor"],
        [("K1", "600"), ("K1", "400"), ("K2", "2000"), ("K3", "1000"), ("K4", "1000,0")],
    )
    b = table(["chave", "valor"], [("K1", "1000"), ("K2", "1000"), ("K3", "2000"), ("K5", "500")])
    got = group_result(a, b)
    labels = {k: (r["status"], r["grupo"]) for k, r in got.items()}
    assert labels == {"K1": DONE, "K2": A_MORE, "K3": B_MORE, "K4": ABSENT, "K5": ABSENT}
    assert (got["K4"]["soma_b"], got["K4"]["has_b"], got["K4"]["diff"]) == (0.0, False, 1000.0)
    assert (got["K5"]["soma_a"], got["K5"]["has_a"], got["K5"]["diff"]) == (0.0, False, -500.0)


def two_keys(limit=0.0, invert=False):
    keys = build_keys({"CHAVE_1": ["k1"], "CHAVE_2": ["k2"]}, {"CHAVE_1": ["k1"]})
    return RowConfig(keys, "valor", "valor", invert, limit)


COLS = ["k1", "k2", "valor"]


def test_priority_and_carry_forward(table):
    a = table(COLS, [("X", "P", "100"), ("Y", "M", "50"), ("W", "N", "30")])
    b = table(COLS, [("X", "Q", "100"), ("Z", "M", "50"), ("V", "R", "20")])
    got = {(r["origem"], r["row_id"]): r for r in reconcile_rows(a, b, two_keys()).collect()}
    assert len(got) == 6
    for side in "AB":
        assert [got[side, i]["key_id"] for i in range(3)] == ["CHAVE_1", "CHAVE_2", None]
        assert [got[side, i]["status"][:2] for i in range(3)] == ["01", "01", "03"]
    last = got["B", 2]
    assert (last["value_a"], last["value_b"], last["difference"]) == (0.0, 20.0, -20.0)
    first = got["A", 0]
    assert (first["CHAVE_1"], first["CHAVE_2"]) == ("X", "P")
    assert first["a_values"] == '{"k1":"X","k2":"P","valor":"100"}'
    assert first["b_values"] is None


def test_rows_carry_the_sums_of_their_group(table):
    a = table(COLS, [("X", "", "600"), ("X", "", "400")])
    b = table(COLS, [("X", "", "1000")])
    got = reconcile_rows(a, b, two_keys()).collect()
    assert {(r["value_a"], r["value_b"]) for r in got} == {(1000.0, 1000.0)}


def test_marked_rows_leave_first(spark, table):
    a = table(COLS, [("X", "P", "100")])
    b = table(COLS, [("X", "P", "100")])
    marks = spark.createDataFrame([(0, "04_Não Avaliado", "g")], "row_id long, status string, grupo string")
    got = {r["origem"]: r for r in reconcile_rows(a, b, two_keys(invert=True), marks_a=marks).collect()}
    assert (got["A"]["status"], got["A"]["grupo"], got["A"]["key_id"]) == ("04_Não Avaliado", "g", None)
    assert (got["A"]["value_a"], got["A"]["difference"]) == (100.0, 0.0)
    assert (got["B"]["status"], got["B"]["value_b"], got["B"]["difference"]) == (ABSENT[0], -100.0, 100.0)


def expected_rows(a, b, keys, limit, sign):
    """The rule row by row; ledgers are lists of dicts."""
    rest = {("A", i): r for i, r in enumerate(a)} | {("B", i): r for i, r in enumerate(b)}
    out = {}
    for key_id, cols in keys:
        groups = {}
        for (side, i), r in rest.items():
            groups.setdefault("_".join(r[c] or "" for c in cols), []).append((side, i))
        for k, members in groups.items():
            if {s for s, _ in members} == {"A", "B"}:
                sa = six(sum(rest[m]["n"] for m in members if m[0] == "A"))
                sb = six(sign * sum(rest[m]["n"] for m in members if m[0] == "B"))
                for m in members:
                    out[m] = (key_id, *judge(sa, sb, limit), k, sa, sb, six(sa - sb))
        rest = {m: r for m, r in rest.items() if m not in out}
    for (side, i), r in rest.items():
        sa, sb = (six(r["n"]), 0.0) if side == "A" else (0.0, six(sign * r["n"]))
        out[side, i] = (None, *ABSENT, None, sa, sb, six(sa - sb))
    return out


@pytest.mark.parametrize("seed, invert, limit", [(1, False, 0.0), (2, True, 1.5), (3, False, 3.0)])
def test_random_ledgers_follow_the_rule(spark, seed, invert, limit):
    rng = random.Random(seed)

    def ledger(n):
        rows = []
        for _ in range(n):
            cents = rng.randint(-400, 400)
            keys = [rng.choice(["", None, *"abcdefghijklmnop"]) for _ in range(3)]
            text = f"{cents / 100:.2f}"
            rows.append(
                {"k1": keys[0] or "", "k2": keys[1], "k3": keys[2], "n": cents / 100,
                 "valor": text.replace(".", ",") if rng.random() < 0.5 else text}
            )
        return rows

    a, b = ledger(60), ledger(50)
    cols = ["k1", "k2", "k3", "valor"]

    def frame(rows):
        ddl = "row_id long, " + ", ".join(f"{c} string" for c in cols)
        return spark.createDataFrame([(i, *[r[c] for c in cols]) for i, r in enumerate(rows)], ddl)

    keys = [("CHAVE_1", ["k1", "k2", "k3"]), ("CHAVE_2", ["k1", "k2"]), ("CHAVE_3", ["k2"]), ("CHAVE_4", ["k3"])]
    cfg = RowConfig([KeyDef(i, c, c) for i, c in keys], "valor", "valor", invert, limit)
    result = reconcile_rows(frame(a), frame(b), cfg).collect()
    assert len(result) == len(a) + len(b)
    got = {
        (r["origem"], r["row_id"]): (
            r["key_id"], r["status"], r["grupo"], r["chave_valor"], r["value_a"], r["value_b"], r["difference"],
        )
        for r in result
    }
    assert got == expected_rows(a, b, keys, limit, -1 if invert else 1)


def test_sides_may_use_different_columns(table):
    a = table(["nota", "valor"], [("1", "10"), ("2", "5")])
    b = table(["documento", "serie", "total"], [("1", "u", "10"), ("3", "u", "1")])
    cfg = RowConfig([KeyDef("CHAVE_1", ["nota"], ["documento"])], "valor", "total")
    got = {(r["origem"], r["row_id"]): r for r in reconcile_rows(a, b, cfg).collect()}
    assert got["A", 0]["status"] == got["B", 0]["status"] == DONE[0]
    assert got["B", 1]["b_values"] == '{"documento":"3","total":"1"}'
    assert got["A", 1]["a_values"] == '{"nota":"2","valor":"5"}'


def test_cancelled_rows(table):
    b = table(["indicador"], [("S",), ("s",), (" S ",), ("N",), (None,)])
    exact = cancel_marks(b, CancelConfig("indicador"))
    assert [r["row_id"] for r in exact.collect()] == [0]
    relaxed = cancel_marks(b, CancelConfig("indicador", "S", relaxed=True)).collect()
    assert sorted(r["row_id"] for r in relaxed) == [0, 1, 2]
    assert {(r["status"], r["grupo"]) for r in relaxed} == {("04_Não Avaliado", "NF Cancelada")}


def test_configuration_is_checked():
    with pytest.raises(ValueError):
        RowConfig([], "v", "v")
    with pytest.raises(ValueError):
        KeyDef("CHAVE_1", [], ["x"])
    with pytest.raises(ValueError):
        RowConfig([KeyDef("C", ["a"], ["a"])] * 2, "v", "v")
    keys = build_keys({"K1": ["a"], "K2": [], "K3": ["c"]}, {"K1": ["b"], "K2": ["x"]})
    assert [(k.key_id, k.cols_a, k.cols_b) for k in keys] == [("K1", ("a",), ("b",)), ("K3", ("c",), ("c",))]


def test_one_key_holds_half_of_the_rows(spark):
    """A blank key on both sides; the join back is split into pieces by adaptive execution."""
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        def side(n, value):
            k1 = F.when(F.col("id") % 2 == 0, "").otherwise(F.col("id").cast("string"))
            return spark.range(0, n, 1, 8).select(
                F.col("id").alias("row_id"), k1.alias("k1"), F.lit("z").alias("k2"), F.lit(value).alias("valor")
            )

        a, b = side(20000, "1"), side(10000, "2")
        cfg = RowConfig([KeyDef("CHAVE_1", ["k1"], ["k1"])], "valor", "valor")
        result = reconcile_rows(a, b, cfg)
        totals = {r["status"]: r["total"] for r in counts_by(result, "status").collect()}
        # The blank key sums to 10,000 on both sides; odd ids differ, or miss on side B.
        assert totals == {"01_Conciliado": 15000, "02_Encontrado c/Diferença": 10000, "03_Não Encontrado": 5000}
        result.collect()
        assert "skew=true" in result._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
