"""The library on the shared test tables; each query takes (spark, folder) and is lazy at the end."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.functions.scalars import (
    cancels_in_cents,
    cents_index,
    clean_key_value,
    derive,
    import_value,
    is_empty,
    money_text,
    normalize_nulls,
    number_or_null,
    number_or_zero,
)
from ledgerlink.model import (
    ONLY_EMPTY,
    OVERWRITE,
    AttributionConfig,
    AttributionKey,
    CancelConfig,
    GroupConfig,
    ReversalConfig,
    RowConfig,
    build_keys,
)
from ledgerlink.operators import results
from ledgerlink.operators.attribution import attribute, attribution_counts, write_back
from ledgerlink.operators.cancel import cancel_marks
from ledgerlink.operators.groups import reconcile_groups
from ledgerlink.operators.multikey import reconcile_rows
from ledgerlink.operators.reversal import reversal_marks
from ledgerlink.plans import export
from ledgerlink.plans.flow import run_groups, run_rows
from ledgerlink.plans.workbooks import write_workbooks
from ledgerlink.scratch import remember, shared_folder
from ledgerlink.sources.catalog import copy_monetary, map_columns, mapped_pairs, monetary_columns, named_columns, set_monetary
from ledgerlink.sources.delimited import read_delimited
from ledgerlink.sources.rowid import duplicate_row_ids, parquet_with_row_id
from ledgerlink.sources.workbook import SheetSpec, read_workbooks
from ledgerlink.versions import published

from .ledgers import (
    DESTINATION,
    LEDGER_A,
    LEDGER_B,
    LEDGER_B_NEGATIVE,
    LEDGER_DUAL,
    LEDGER_HOT,
    LEDGER_LINES,
    LEDGER_R,
    ORIGIN,
    REMARKS,
    SHEET,
    TEXTS,
)

_TABLES = ("orders", "lineitem", "customer")

KEYS = build_keys({"CHAVE_1": ["doc"], "CHAVE_2": ["cust", "dia"]}, {})
OUTCOME = (
    "origem row_id key_id status grupo chave_valor value_a value_b difference CHAVE_1 CHAVE_2"
).split()
FOUND = "02_Encontrado c/Diferença"
ATTRIBUTION_KEYS = (
    AttributionKey("CHAVE_1", ["cust"], ["cust"]),
    AttributionKey("CHAVE_2", ["seg"], ["seg"]),
)
REVERSAL = ReversalConfig("doc", "ref", "valor", 0.5)
# Rows of a workbook, about.
SHEET_ROWS = 50_000
CANCEL = CancelConfig("indicador", "S")


@lru_cache
def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; its schema is read once per session. The small ones are one row group each."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ledger(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """A derived ledger over the tables of ``folder``."""
    for t in _TABLES:
        if f"from {t}" in sql:
            _table(spark, folder, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def _by(cols: list[str], limit: float, invert: bool = False) -> GroupConfig:
    return GroupConfig(cols, cols, "valor", "valor", invert, limit)


def recon_orders_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines = _table(spark, folder, "orders"), _table(spark, folder, "lineitem")
    cfg = GroupConfig(
        ["o_orderkey"], ["l_orderkey"], "o_totalprice", "l_extendedprice", limit=50000.0
    )
    return reconcile_groups(orders, lines, cfg)


def _pair_groups(s: SparkSession, d: str, limit: float = 1.0) -> DataFrame:
    return reconcile_groups(ledger(s, d, LEDGER_A), ledger(s, d, LEDGER_B), _by(["doc"], limit))


def recon_groups_inverted(s: SparkSession, d: str) -> DataFrame:
    b = ledger(s, d, LEDGER_B_NEGATIVE)
    return reconcile_groups(ledger(s, d, LEDGER_A), b, _by(["doc"], 1.0, invert=True))


def recon_groups_composite(s: SparkSession, d: str) -> DataFrame:
    a, b = ledger(s, d, LEDGER_A), ledger(s, d, LEDGER_B)
    return reconcile_groups(a, b, _by(["cust", "dia"], 0.0))


def _pair_rows(s: SparkSession, d: str) -> DataFrame:
    cfg = RowConfig(KEYS, "valor", "valor", limit=1.0)
    return reconcile_rows(ledger(s, d, LEDGER_A), ledger(s, d, LEDGER_B), cfg)


def multikey_marked(s: SparkSession, d: str) -> DataFrame:
    b = ledger(s, d, LEDGER_B)
    cfg = RowConfig(KEYS, "valor", "valor")
    marks = cancel_marks(b, CANCEL)
    return reconcile_rows(ledger(s, d, LEDGER_A), b, cfg, marks_b=marks).select(*OUTCOME)


def _reversal(s: SparkSession, d: str, limit: float) -> DataFrame:
    return reversal_marks(ledger(s, d, LEDGER_R), ReversalConfig("doc", "ref", "valor", limit))


def reversal_chains(s: SparkSession, d: str, **options: int) -> DataFrame:
    lines = parquet_with_row_id(s, f"{d}/lineitem.parquet")
    lines.createOrReplaceTempView("lineitem_rows")
    return reversal_marks(s.sql(LEDGER_LINES), ReversalConfig("doc", "ref", "valor", 25.0), **options)


def reversal_dual(s: SparkSession, d: str) -> DataFrame:
    return reversal_marks(ledger(s, d, LEDGER_DUAL), ReversalConfig("doc", "ref", "valor", 0.5))


def reversal_hot_cell(s: SparkSession, d: str) -> DataFrame:
    """One key with most rows and few amounts; the size from which counts are taken is set low."""
    cfg = ReversalConfig("doc", "ref", "valor", 1.0)
    return reversal_marks(ledger(s, d, LEDGER_HOT), cfg, max_component=1000)


def _flow_groups(s: SparkSession, d: str):
    a, b = ledger(s, d, LEDGER_R), ledger(s, d, LEDGER_B)
    return run_groups(a, b, _by(["doc"], 1.0), REVERSAL, CANCEL)


def _flow_rows(s: SparkSession, d: str):
    a, b = ledger(s, d, LEDGER_R), ledger(s, d, LEDGER_B)
    return run_rows(a, b, RowConfig(KEYS, "valor", "valor", limit=1.0), REVERSAL, CANCEL)


def _attribution(mode: str) -> AttributionConfig:
    return AttributionConfig(ATTRIBUTION_KEYS, ("nome", "saldo", "cidade"), mode)


def _attribute(s: SparkSession, d: str, mode: str) -> DataFrame:
    return attribute(ledger(s, d, ORIGIN), ledger(s, d, DESTINATION), _attribution(mode))


def attrib_counts(s: SparkSession, d: str) -> DataFrame:
    return attribution_counts(_attribute(s, d, OVERWRITE), _attribution(OVERWRITE))


def attrib_writeback(s: SparkSession, d: str) -> DataFrame:
    return write_back(ledger(s, d, ORIGIN), ledger(s, d, DESTINATION), _attribution(ONLY_EMPTY))


def attrib_search(s: SparkSession, d: str) -> DataFrame:
    found = results.search_any(_attribute(s, d, OVERWRITE), "er#0%77")
    return found.select("dest_row_id", "orig_row_id", "matched_key", "nome")


def number_parse(s: SparkSession, d: str) -> DataFrame:
    return ledger(s, d, TEXTS).select(
        "row_id", number_or_null("valor").alias("n"), number_or_zero("valor").alias("z")
    )


def derived_columns(s: SparkSession, d: str) -> DataFrame:
    df = derive(derive(ledger(s, d, TEXTS), "valor", "ABS"), "valor", "INVERTER")
    return df.select("row_id", "abs_valor", "inverter_valor")


def import_values(s: SparkSession, d: str) -> DataFrame:
    return ledger(s, d, TEXTS).select(
        "row_id",
        is_empty("valor").alias("vazio"),
        import_value("valor").alias("importado"),
        clean_key_value("valor").alias("chave"),
    )


def money_values(s: SparkSession, d: str) -> DataFrame:
    return ledger(s, d, TEXTS).select("row_id", money_text("valor").alias("valor"))


def cents(s: SparkSession, d: str) -> DataFrame:
    total = F.col("o_totalprice")
    return _table(s, d, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        cents_index(total).alias("centavos"),
        cancels_in_cents(total, -(total + F.lit(0.002))).alias("anula"),
    )


def result_page(s: SparkSession, d: str) -> DataFrame:
    return results.page(results.filter_result(_pair_rows(s, d), FOUND), 3, 50).select(*OUTCOME)


def result_deep_page(s: SparkSession, d: str) -> DataFrame:
    """A page far into the whole result."""
    return results.page(_pair_rows(s, d), 40, 50).select(*OUTCOME)


def result_page_by_text(s: SparkSession, d: str) -> DataFrame:
    """A page in the order of a text column with many equal values, then of row ids."""
    return results.page(_pair_rows(s, d), 25, 40, ("grupo", "row_id", "origem")).select(*OUTCOME)


def attrib_page(s: SparkSession, d: str) -> DataFrame:
    return results.page(_attribute(s, d, OVERWRITE), 9, 60, ("dest_row_id",))


def result_search(s: SparkSession, d: str) -> DataFrame:
    found = results.filter_result(_pair_rows(s, d), FOUND, "7_1", "chave_valor")
    return found.select(*OUTCOME)


def result_diff(s: SparkSession, d: str) -> DataFrame:
    return results.diff_results(_pair_groups(s, d), _flow_groups(s, d).result, "chave", "grupo")


def result_diff_counts(s: SparkSession, d: str) -> DataFrame:
    exact = _pair_groups(s, d, 0.0)
    return results.diff_counts(results.diff_results(_pair_groups(s, d), exact, "chave", "grupo"))


def export_base_a(s: SparkSession, d: str) -> DataFrame:
    return export.base_with_result(ledger(s, d, LEDGER_A), _pair_rows(s, d), "A")


def parquet_row_ids(s: SparkSession, d: str) -> DataFrame:
    df = parquet_with_row_id(s, f"{d}/orders.parquet")
    return df.select("row_id", "o_orderkey", "o_totalprice")


def delimited_ledger(s: SparkSession, d: str) -> DataFrame:
    """Side A written as delimited files with headers and read back."""
    df = ledger(s, d, LEDGER_A).select("doc", "cust", "dia", "valor")
    path = _folder(s, "ledger-a-csv")
    export.export(df, path, "csv", money=())
    read = read_delimited(s, path, row_id=None)
    # Blank fields come back as NULL; the ledger has no NULL of its own.
    return read.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in read.columns])


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s).rstrip('/')}/ledgerlink-{s.sparkContext.applicationId}/{name}"


def _delimited(s: SparkSession, d: str, sql: str, name: str) -> DataFrame:
    """A ledger written as several delimited files in row order, and read back with row ids."""
    df = ledger(s, d, sql)
    path = _folder(s, name)
    laid = df.repartitionByRange(4, "row_id").sortWithinPartitions("row_id").drop("row_id")
    laid.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_delimited(s, path)


def delimited_row_ids(s: SparkSession, d: str) -> DataFrame:
    return _delimited(s, d, LEDGER_A, "ledger-a-rows").select("row_id", "doc", "valor")


def delimited_quoted(s: SparkSession, d: str) -> DataFrame:
    return _delimited(s, d, REMARKS, "remarks")


def _zero_sum(s: SparkSession, d: str, sql: str) -> DataFrame:
    return reversal_marks(ledger(s, d, sql), ReversalConfig("doc", "ref", "valor", 0.25, zero_sum_groups=True))


def row_id_duplicates(s: SparkSession, d: str) -> DataFrame:
    return duplicate_row_ids(_table(s, d, "lineitem"), "l_orderkey")


def workbook_ledger(s: SparkSession, d: str) -> DataFrame:
    """A ledger written as workbooks by the tasks and read back, each sheet in several parts."""
    folder = remember(s, _folder(s, f"sheets-{uuid4().hex}"))
    rows = ledger(s, d, SHEET)
    books = max(3, -(-rows.count() // SHEET_ROWS))  # one task writes a workbook
    laid = rows.repartitionByRange(books, "row_id").sortWithinPartitions("row_id").drop("row_id")
    headers = ["Nº Doc", "Valor", " valor ", "Ativo", "", "Nota"]
    write_workbooks(laid, folder, headers, first_row=3, first_col=2)
    return read_workbooks(s, folder, SheetSpec(3, 2), split_bytes=512 * 1024).drop("row_id")


def money_of_flagged(s: SparkSession, d: str) -> DataFrame:
    """Flags of side A go to the columns of side B with the same header, whose money is then shown."""
    a = named_columns(ledger(s, d, LEDGER_A).select("row_id", "doc", "valor"), ["row_id", "Doc", "Valor"])
    b = ledger(s, d, LEDGER_B).select("row_id", "doc", "valor", F.col("valor").alias("item"))
    b = named_columns(b, ["row_id", "Nota", "Valor", "Valor do Item"])
    flagged, _ = copy_monetary(set_monetary(a, ["valor"]), b, "source_name")
    return export.with_money_text(flagged, monetary_columns(flagged))


def recon_mapped(s: SparkSession, d: str) -> DataFrame:
    """Key and amount of side B found by the column mapping."""
    a = ledger(s, d, LEDGER_A)
    b = ledger(s, d, LEDGER_B).withColumnsRenamed({"doc": "nota", "valor": "total"})
    on_b = dict(mapped_pairs(map_columns(a.columns, b.columns, [("doc", "nota"), ("valor", "total")])))
    keys = ["doc", "cust"]
    return reconcile_groups(a, b, GroupConfig(keys, [on_b[c] for c in keys], "valor", on_b["valor"], limit=1.0))


def result_unmarked(s: SparkSession, d: str) -> DataFrame:
    """Rows that no reversal marked: those without a status."""
    a = ledger(s, d, LEDGER_R)
    marked = a.join(reversal_marks(a, REVERSAL), "row_id", "left")
    return results.filter_result(marked, results.NULL_STATUS).select("row_id", "doc", "valor")


def result_saved(s: SparkSession, d: str) -> DataFrame:
    """A saved result replaces the one before it."""
    path = remember(s, _folder(s, f"saved-{uuid4().hex}"))
    for limit in (0.0, 1.0):
        export.save_result(_pair_groups(s, d, limit), path)
    return s.read.parquet(published(s, path))


def preview_rows(s: SparkSession, d: str) -> DataFrame:
    return results.preview(ledger(s, d, LEDGER_A).orderBy("row_id")).select("row_id", "doc", "valor")


def export_base_b(s: SparkSession, d: str) -> DataFrame:
    return export.base_with_result(ledger(s, d, LEDGER_B), _pair_rows(s, d), "B")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "recon_orders_lineitem": recon_orders_lineitem,
        "recon_groups_pair": _pair_groups,
        "recon_groups_inverted": recon_groups_inverted,
        "recon_groups_composite": recon_groups_composite,
        "multikey_rows": lambda s, d: _pair_rows(s, d).select(*OUTCOME),
        "multikey_payload": lambda s, d: _pair_rows(s, d).select(
            "origem", "row_id", "a_values", "b_values"
        ),
        "multikey_marked": multikey_marked,
        "multikey_status_counts": lambda s, d: results.counts_by(_pair_rows(s, d), "status"),
        "multikey_group_counts": lambda s, d: results.counts_by(_pair_rows(s, d), "grupo"),
        "cancel_marks": lambda s, d: cancel_marks(ledger(s, d, LEDGER_B), CANCEL),
        "reversal_exact": lambda s, d: _reversal(s, d, 0.0),
        "reversal_tolerant": lambda s, d: _reversal(s, d, 0.5),
        "reversal_chains": reversal_chains,
        "reversal_chunked": lambda s, d: reversal_chains(s, d, max_component=10),
        "reversal_cells": lambda s, d: reversal_chains(s, d, max_amounts=100),
        "reversal_dual": reversal_dual,
        "reversal_hot_cell": reversal_hot_cell,
        "flow_groups": lambda s, d: _flow_groups(s, d).result,
        "flow_rows": lambda s, d: _flow_rows(s, d).result.select(*OUTCOME),
        "flow_counters": lambda s, d: _flow_rows(s, d).save(_folder(s, "flow-rows")).counters,
        "flow_distribution": lambda s, d: _flow_groups(s, d).save(_folder(s, "flow-groups")).distribution,
        "attrib_overwrite": lambda s, d: _attribute(s, d, OVERWRITE),
        "attrib_only_empty": lambda s, d: _attribute(s, d, ONLY_EMPTY),
        "attrib_counts": attrib_counts,
        "attrib_writeback": attrib_writeback,
        "attrib_search": attrib_search,
        "number_parse": number_parse,
        "null_normalise": lambda s, d: normalize_nulls(ledger(s, d, TEXTS), ["valor"]),
        "derived_columns": derived_columns,
        "import_values": import_values,
        "money_values": money_values,
        "cents_index": cents,
        "result_page": result_page,
        "result_deep_page": result_deep_page,
        "result_page_by_text": result_page_by_text,
        "attrib_page": attrib_page,
        "result_page_info": lambda s, d: results.page_info(_pair_rows(s, d)),
        "result_search": result_search,
        "result_diff": result_diff,
        "result_diff_counts": result_diff_counts,
        "export_base_a": export_base_a,
        "export_comparison": lambda s, d: export.comparison(_pair_groups(s, d)),
        "parquet_row_ids": parquet_row_ids,
        "delimited_ledger": delimited_ledger,
        "delimited_row_ids": delimited_row_ids,
        "delimited_quoted": delimited_quoted,
        "reversal_zero_sum": lambda s, d: _zero_sum(s, d, LEDGER_R),
        "reversal_zero_sum_dual": lambda s, d: _zero_sum(s, d, LEDGER_DUAL),
        "row_id_duplicates": row_id_duplicates,
        "workbook_ledger": workbook_ledger,
        "monetary_columns": money_of_flagged,
        "recon_mapped": recon_mapped,
        "result_unmarked": result_unmarked,
        "result_saved": result_saved,
        "preview_rows": preview_rows,
        "export_base_b": export_base_b,
    }
