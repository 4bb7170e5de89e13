import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlink.functions.scalars import (
    amount,
    cancels_in_cents,
    cents_index,
    clean_key_value,
    composite_key,
    derive,
    exact_sum,
    import_value,
    is_empty,
    money_text,
    normalize_nulls,
    number_or_null,
    number_or_zero,
    parse_money_br,
    round_amount,
    row_payload,
)


def evaluate(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(expr(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]


NUMBERS = {
    "2790022,95": 2790022.95, "  99,90  ": 99.9, "1e3": 1000.0, "+5": 5.0, ".5": 0.5, "5.": 5.0,
    "\t5": 5.0, "1234,56": 1234.56, "-7": -7.0,
    "1.234,56": None, "abc": None, "": None, None: None, "0x1A": None, "1 000": None, "1d": None,
    "2f": None, "3D": None, "1_000": None, "NaN": None, "inf": None, "-Infinity": None,
    "0x1p3": None, "1e400": None, ".": None, "-": None, "1,2,3": None,
}


def test_number_parsing(spark):
    texts = list(NUMBERS)
    assert evaluate(spark, texts, number_or_null) == list(NUMBERS.values())
    zero = [0.0 if v is None else v for v in NUMBERS.values()]
    assert evaluate(spark, texts, number_or_zero) == zero


def test_typed_amounts_are_not_parsed(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in df.select(amount(df, "v")).collect()] == [1.5, 0.0, 0.0]
    whole = spark.createDataFrame([(3,), (None,)], "v long")
    assert [r[0] for r in whole.select(amount(whole, "v")).collect()] == [3.0, 0.0]


def test_rounding_to_six_decimals(spark):
    values = [80.9399999, 4e-7, 6e-7, -1234.5678901, -4e-7, 0.0]
    got = evaluate(spark, values, round_amount, "double")
    assert got == [80.94, 0.0, 1e-6, -1234.56789, 0.0, 0.0]
    assert all(math.copysign(1, v) == 1 for v in got if v == 0)


def test_cents(spark):
    values = [1000.0, 1000.004, 1000.005, -1000.005, 0.0]
    assert evaluate(spark, values, cents_index, "double") == [100000, 100000, 100001, -100000, 0]
    assert evaluate(spark, [5.0, 5.004, 5.02], lambda c: cancels_in_cents(c, F.lit(-5.0)), "double") == [
        True, True, False,
    ]


def test_composite_key(spark):
    df = spark.createDataFrame([("001", "X"), (None, "X"), ("", None)], "a string, b string")
    assert [r[0] for r in df.select(composite_key(["a", "b"])).collect()] == ["001_X", "_X", "_"]
    with pytest.raises(ValueError):
        composite_key([])


def test_emptiness_and_import(spark):
    values = [None, "", "   ", "null", "NULL", "Null ", "0", "0.00", "0.0", "x", " 5 ", "100,50"]
    assert evaluate(spark, values, is_empty) == [True] * 8 + [False] * 4
    assert evaluate(spark, values, import_value) == ["NULL"] * 8 + ["0.0", "x", "5", "100,50"]
    assert evaluate(spark, [None, " null", " a "], clean_key_value) == ["", "", "a"]


def test_null_normalisation(spark):
    df = spark.createDataFrame(
        [("", "", "1,5"), ("7", None, "abc"), ("8", "x", None)], "id string, nota string, valor string"
    )
    got = [tuple(r) for r in normalize_nulls(df, ["valor"]).collect()]
    assert got == [("", None, 1.5), ("7", None, 0.0), ("8", "x", 0.0)]


def test_derived_columns(spark):
    df = spark.createDataFrame([("-3,5",), ("x",)], "v string")
    out = derive(derive(df, "v", "abs"), "v", "INVERTER")
    assert [tuple(r) for r in out.collect()] == [("-3,5", 3.5, 3.5), ("x", None, None)]
    assert out.schema["abs_v"].metadata["monetary"] is True
    again = derive(out, "v", "ABS")
    assert again.columns == out.columns
    with pytest.raises(ValueError):
        derive(df, "v", "SQRT")


def test_payload_keeps_nulls(spark):
    df = spark.createDataFrame([("a", None)], "k string, v string")
    got = df.select(row_payload([("k", F.col("k")), ("v", F.col("v"))])).first()[0]
    assert got == '{"k":"a","v":null}'


def test_money_for_export(spark):
    assert evaluate(spark, ["12345,6", "x", None, "-1"], money_text) == ["12,345.60", "x", None, "-1.00"]
    assert evaluate(spark, ["12.345,67", "5.5", "1,5"], parse_money_br) == [12345.67, 5.5, 1.5]


def test_sums_do_not_depend_on_the_order(spark):
    rng = random.Random(4)
    cents = [rng.randint(-(10**9), 10**9) for _ in range(20000)]
    want = sum(cents) / 100
    for parts in (1, 3, 16):
        rng.shuffle(cents)
        df = spark.createDataFrame([(c / 100,) for c in cents], "v double").repartition(parts)
        assert df.select(exact_sum(F.col("v"))).first()[0] == want


@pytest.mark.parametrize(
    "values, total",
    [
        ([], None),
        ([None], None),
        ([None, 1.5], 1.5),
        ([0.1] * 10, 1.0),
        ([-0.1] * 3, -0.3),
        ([1000.0000005], 1000.000001),
        ([-1000.0000005], -1000.000001),
        ([-0.25, 0.5, -7.0], -6.75),
        ([1e300, 1.0], 1e300),
        ([1e15, 0.5], 1e15 + 0.5),
        ([1e15, -1e15, 2.0], 2.0),
        ([999999999999.0] * 3, 2999999999997.0),
    ],
)
def test_sum_of_amounts(spark, values, total):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.select(round_amount(exact_sum(F.col("v")))).first()[0] == total


def test_small_amounts_are_rounded_after_the_sum(spark):
    rows = [("a", 4e-7)] * 10 + [("b", 4e-6), ("c", -4e-7), ("c", -1e-7), ("d", 5e-7), ("e", 1e15), ("e", 0.25)]
    df = spark.createDataFrame(rows, "k string, v double").groupBy("k").agg(exact_sum(F.col("v")).alias("s"))
    assert {r["k"]: r["s"] for r in df.collect()} == {"a": 4e-6, "b": 4e-6, "c": -1e-6, "d": 1e-6, "e": 1e15 + 0.25}
