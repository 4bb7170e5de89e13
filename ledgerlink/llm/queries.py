"""The operators of this package as checked queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attention, byte_bpe, fuzzy, huffman, interactions, jaccard, language, lines, mixing, pages, passages, repair, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            huffman.op1_huffman,
            attention.op2_quality,
            fuzzy.op3_fingerprints,
            lines.op4_line_rules,
            jaccard.op5_jaccard,
            language.op6_language,
            mixing.op7_mixing,
            pages.op8_main_text,
            passages.op9_passages,
            byte_bpe.op10_byte_bpe,
            interactions.op11_filter_audit,
            repair.op12_repair,
            toxicity.op13_toxicity,
        )
    }


def oracle_sql() -> dict[str, str]:
    """Expected results of those that SQL can express; tests hold the others against plain versions."""
    return {
        "op5_jaccard": jaccard.OP5_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op9_passages": passages.OP9_SQL,
        "op11_filter_audit": interactions.OP11_SQL,
    }
