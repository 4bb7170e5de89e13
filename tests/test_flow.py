import glob
import gzip

import pytest
from pyspark.sql import functions as F

from ledgerlink import scratch
from ledgerlink.model import CancelConfig, GroupConfig, KeyDef, ReversalConfig, RowConfig
from ledgerlink.operators import results
from ledgerlink.plans import export
from ledgerlink.sources.load import load_base
from ledgerlink.versions import published
from ledgerlink.plans.flow import run_groups, run_rows

REVERSAL = ReversalConfig("doc", "ref", "valor")
CANCEL = CancelConfig("indicador")
BY_KEY = GroupConfig(["chave"], ["chave"], "valor", "valor")
ROWS = RowConfig([KeyDef("CHAVE_1", ["chave"], ["chave"])], "valor", "valor")


@pytest.fixture
def ledgers(table):
    a = table(
        ["chave", "doc", "ref", "valor"],
        [
            ("K1", "D1", "", "1000"), ("K1", "", "D1", "-1000"),
            ("K2", "D2", "", "500"), ("K3", "D3", "", "300"),
        ],
    )
    b = table(
        ["chave", "indicador", "valor"], [("K1", "S", "1000"), ("K2", "N", "500"), ("K3", None, "250")]
    )
    return a, b


def test_group_level_run(ledgers):
    run = run_groups(*ledgers, BY_KEY, REVERSAL, CANCEL)
    assert {r["chave"]: r["status"][:2] for r in run.result.collect()} == {"K2": "01", "K3": "02"}
    assert run.counters.first().asDict() == {
        "estorno_pares": 2, "estorno_docs": 0, "canceladas": 1, "linhas": 2,
    }
    assert {r["status"][:2]: r["total"] for r in run.distribution.collect()} == {"01": 1, "02": 1}


def test_row_level_run(ledgers):
    run = run_rows(*ledgers, ROWS, REVERSAL, CANCEL)
    got = {(r["origem"], r["row_id"]): r["grupo"] for r in run.result.collect()}
    assert got == {
        ("A", 0): "Conciliado_Estorno", ("A", 1): "Conciliado_Estorno",
        ("A", 2): "Conciliado", ("A", 3): "Encontrado com diferença, BASE A MAIOR",
        ("B", 0): "NF Cancelada", ("B", 1): "Conciliado",
        ("B", 2): "Encontrado com diferença, BASE A MAIOR",
    }
    assert run.counters.first()["linhas"] == 7


def test_run_without_marks(ledgers):
    run = run_rows(*ledgers, ROWS)
    assert run.result.count() == 7
    assert run.counters.first()["canceladas"] == 0
    groups = run_groups(*ledgers, BY_KEY).result
    assert groups.count() == 3


def test_counts_filters_and_search(ledgers):
    result = run_rows(*ledgers, ROWS, REVERSAL, CANCEL).result
    assert [r["total"] for r in results.counts_by(result, "status").collect()] == [4, 2, 1]
    assert results.total_rows(result).first()["total"] == 7
    only = results.filter_result(result, "01_Conciliado")
    assert only.count() == 4
    assert results.filter_result(result, "__NULL__").count() == 0
    assert results.filter_result(result, None, "k2", "chave_valor").count() == 2
    assert results.filter_result(result, None, "k_", "chave_valor").count() == 4
    assert results.filter_result(result, None, "k2", "no_such_column").count() == 7
    assert results.search_any(result, "cancelada").count() == 1
    assert results.search_any(result, None).count() == 7
    assert results.filter_result(result, None, "\\", "chave_valor").count() == 0
    assert results.key_columns(result) == ["CHAVE_1"]
    assert results.preview(result, 3).count() == 3


@pytest.mark.parametrize("leaf, ranges", [(10**6, 64), (60, 4), (7, 16)])
def test_pages_shallow_and_deep(spark, monkeypatch, leaf, ranges):
    rows = spark.range(0, 3000, 1, 6).select(
        F.expr("id * 1000 div 2").alias("row_id"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("origem")
    )
    want = sorted((i * 1000 // 2, "AB"[i % 2]) for i in range(3000))
    monkeypatch.setattr(results, "LEAF_ROWS", leaf)
    monkeypatch.setattr(results, "RANGES", ranges)
    for number, size in [(1, 50), (60, 50), (2, 2500), (99, 50)]:
        assert [tuple(r) for r in results.page(rows, number, size).collect()] == want[(number - 1) * size : number * size]
    assert results.page_info(rows, 50).first().asDict() == {"total": 3000, "total_pages": 60}
    with pytest.raises(ValueError):
        results.page(rows, 0)


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_pages_keep_rows_without_an_id(spark, monkeypatch, kind):
    monkeypatch.setattr(results, "LEAF_ROWS", 40)
    monkeypatch.setattr(results, "RANGES", 8)
    rows = spark.range(0, 1000, 1, 6).select(
        F.when(F.col("id") % 10 > 0, F.col("id") - 500).cast(kind).alias("row_id"), F.col("id").cast("string").alias("origem")
    )
    want = [tuple(r) for r in rows.orderBy("row_id", "origem").collect()]
    pages = [results.page(rows, n, 300).collect() for n in range(1, 6)]
    assert [len(p) for p in pages] == [300, 300, 300, 100, 0]
    assert [tuple(r) for p in pages for r in p] == want


def test_pages_of_rows_that_are_alike(spark, monkeypatch):
    """Ties in the order, and rows that are equal altogether: every row is on one page."""
    monkeypatch.setattr(results, "LEAF_ROWS", 20)
    monkeypatch.setattr(results, "RANGES", 8)
    rows = spark.range(0, 300, 1, 4).select((F.col("id") % 3).cast("string").alias("t"), F.when(F.col("id") < 200, 7).otherwise(F.col("id")).alias("v"))
    got = [tuple(r) for n in range(1, 8) for r in results.page(rows, n, 50, ["t"]).collect()]
    assert sorted(got) == sorted(tuple(r) for r in rows.collect())
    assert [t for t, _ in got] == sorted(t for t, _ in got)


def test_saved_runs_count_rows_on_their_way(spark, ledgers, tmp_path):
    for run in (run_rows(*ledgers, ROWS, REVERSAL, CANCEL), run_groups(*ledgers, BY_KEY, REVERSAL, CANCEL)):
        saved = run.save(str(tmp_path / "kept"))
        assert saved.counters.first().asDict() == run.counters.first().asDict()
        assert [tuple(r) for r in saved.distribution.collect()] == [tuple(r) for r in run.distribution.collect()]
        assert sorted(map(str, saved.result.collect())) == sorted(map(str, run.result.collect()))


def test_a_run_that_dies_leaves_the_earlier_result(spark, ledgers, tmp_path):
    path = str(tmp_path / "kept.parquet")
    df = spark.range(100).select(F.col("id").cast("string").alias("a"))
    export.save_result(df, path)
    broken = df.select(F.when(F.col("a") != "77", F.col("a")).otherwise(F.raise_error(F.lit("lost"))).alias("a"))
    with pytest.raises(Exception, match="lost"):
        export.save_result(broken.repartition(8), path)
    assert load_base(spark, path).count() == 100
    export.save_result(df.limit(3), path)
    export.save_result(df.limit(2), path)
    assert load_base(spark, path).count() == 2
    assert len(glob.glob(f"{path}/v-*")) == 2 and not glob.glob(f"{path}/_draft*")


def test_comparison_of_two_results(spark):
    left = spark.createDataFrame([("a", "01"), ("b", "01"), ("c", None), ("d", None)], "k string, s string")
    right = spark.createDataFrame([("b", "02"), ("c", None), ("d", "01"), ("e", "03")], "k string, s string")
    got = results.diff_results(left, right, "k", "s")
    assert sorted(tuple(r) for r in got.collect()) == [
        ("a", "only_left", "01", None),
        ("b", "diverging", "01", "02"),
        ("d", "diverging", None, "01"),
        ("e", "only_right", None, "03"),
    ]
    assert tuple(results.diff_counts(got).first()) == (1, 1, 2)
    assert results.diff_results(left, left, "k", "s").isEmpty()


def test_exports(spark, ledgers, tmp_path):
    result = run_rows(*ledgers, ROWS, REVERSAL, CANCEL).result
    for fmt in export.FORMATS:
        path = str(tmp_path / fmt)
        export.export(result, path, fmt)
        back = spark.read.option("header", True).format(fmt).load(path)
        assert back.count() == 7
        assert set(back.columns) <= set(result.columns)
    export.export(result.orderBy("origem", "row_id").coalesce(1), str(tmp_path / "z"), "csv", as_text=True, compression="gzip")
    with gzip.open(glob.glob(str(tmp_path / "z" / "*.csv.gz"))[0], "rt", encoding="utf-8") as f:
        lines = f.read().splitlines()
    assert lines[0].split(",")[:9] == result.columns[:9]
    assert '"1,000.00"' in lines[1]
    export.save_result(result, str(tmp_path / "kept"))
    export.save_result(result.limit(2), str(tmp_path / "kept"))
    assert spark.read.parquet(published(spark, str(tmp_path / "kept"))).count() == 2
    with pytest.raises(ValueError):
        export.export(result, str(tmp_path / "x"), "xlsx")


def test_export_set(spark, ledgers, tmp_path):
    a, b = ledgers
    result = run_rows(a, b, ROWS, REVERSAL, CANCEL).result
    groups = run_groups(a, b, BY_KEY, REVERSAL, CANCEL).result
    paths = export.export_set(a, b, result, groups, str(tmp_path / "set"))
    sheet_a = spark.read.option("header", True).csv(paths["Base_A"])
    # The ledger has a column ``chave`` of its own.
    assert sheet_a.columns == [*a.columns, "CHAVE_1", "STATUS", "GRUPO", "RESULTADO_CHAVE"]
    assert sheet_a.count() == 4
    assert spark.read.option("header", True).csv(paths["Base_B"]).count() == 3
    compared = spark.read.option("header", True).csv(paths["Base_Comparativo"])
    assert {r["CHAVE"]: r["STATUS"][:2] for r in compared.collect()} == {"K2": "01", "K3": "02"}


def test_intermediate_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", True), (2, "b", False)], "n long, t string, hit boolean")
    copy = scratch.materialize(df, "t", ["hit"])
    assert copy.columns == df.columns
    assert sorted(tuple(r) for r in copy.collect()) == [(1, "a", True), (2, "b", False)]
    empty = scratch.materialize(df.filter("n > 5"), "t", ["hit"])
    assert empty.count() == 0
    assert scratch.shared_folder(spark).removeprefix("file:") in copy.inputFiles()[0]
    assert scratch.release(spark) >= 2
    assert scratch.release(spark) == 0
