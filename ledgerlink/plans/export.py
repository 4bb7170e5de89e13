"""Writing results for other tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import money_text
from ..model import ROW_ID
from ..operators.results import key_columns
from ..versions import publish

MONEY_COLUMNS = ("value_a", "value_b", "difference")
FORMATS = ("csv", "json", "parquet")


def save_result(df: DataFrame, path: str) -> None:
    """Keep a result as Parquet, replacing an earlier one as a whole or not at all.

    The result is written to a folder of its own below ``path`` and then published by one rename of the
    file that names it, so a run that dies midway leaves the earlier result in place. That one is kept
    until the next replacement, for those who are still reading it. Read with ``published``.
    """
    publish(df.write.parquet, df.sparkSession, path)


def with_money_text(df: DataFrame, money: Sequence[str] = MONEY_COLUMNS) -> DataFrame:
    wanted = set(money)
    return df.select(
        *[
            money_text(F.col(f"`{c}`")).alias(c) if c in wanted else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def export(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    money: Sequence[str] = MONEY_COLUMNS,
    as_text: bool = False,
    compression: str | None = None,
) -> None:
    """Write ``df`` with its column order, one file per partition.

    ``as_text`` shows the money columns with thousands marks and two decimals.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown export format {fmt}: use one of {', '.join(FORMATS)}")
    writer = (with_money_text(df, money) if as_text else df).write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    if fmt == "csv":
        # Quotes are doubled and white space stays, so that the file reads back as it was.
        writer = writer.options(header=True, emptyValue="", nullValue="", escape='"')
        writer = writer.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.format(fmt).save(path)


def base_with_result(base: DataFrame, result: DataFrame, side: str, row_id: str = ROW_ID) -> DataFrame:
    """Original columns of one ledger with CHAVE_n, STATUS, GRUPO and CHAVE of each row.

    Row ids are distinct on both sides, so the join is one-to-one. An added column whose name the
    ledger already uses (column names ignore case) is called ``RESULTADO_<name>``.
    """
    used = {c.lower() for c in base.columns}
    added = {**{c: c for c in key_columns(result)}, "STATUS": "status", "GRUPO": "grupo"}
    added["CHAVE"] = "chave_valor"
    own = result.filter(F.col("origem") == side).select(
        F.col(ROW_ID).alias("_rid"),
        *[
            F.col(source).alias(f"RESULTADO_{name}" if name.lower() in used else name)
            for name, source in added.items()
        ],
    )
    return base.join(own, F.col(f"`{row_id}`") == F.col("_rid"), "left").drop("_rid")


def comparison(groups: DataFrame) -> DataFrame:
    """Both ledgers side by side, one row per key."""
    return groups.select(
        F.col("chave").alias("CHAVE"),
        F.when(F.col("has_a"), F.col("soma_a")).alias("SOMA_A"),
        F.when(F.col("has_b"), F.col("soma_b")).alias("SOMA_B"),
        F.col("diff").alias("DIFERENCA"),
        F.col("status").alias("STATUS"),
        F.col("grupo").alias("GRUPO"),
    )


def export_set(
    base_a: DataFrame,
    base_b: DataFrame,
    result: DataFrame,
    groups: DataFrame,
    folder: str,
    fmt: str = "csv",
    row_id: str = ROW_ID,
) -> dict[str, str]:
    """Base_A, Base_B and Base_Comparativo as three sub-folders; returns their paths."""
    parts = {
        "Base_A": base_with_result(base_a, result, "A", row_id),
        "Base_B": base_with_result(base_b, result, "B", row_id),
        "Base_Comparativo": comparison(groups),
    }
    paths = {}
    for name, df in parts.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        export(df, paths[name], fmt, money=("SOMA_A", "SOMA_B", "DIFERENCA"))
    return paths
