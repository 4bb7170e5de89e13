"""Run the checked queries against their SQL and report differences.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from .oracle import oracle_sql
from .spark_queries import queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """First difference between the two results as sets of rows, columns taken by name."""
    names = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=repr)
    cur = con.execute(sql)
    have = [d[0] for d in cur.description]
    if sorted(have) != names:
        return f"columns {names} instead of {sorted(have)}"
    order = [have.index(c) for c in names]
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{dict(zip(names, g))} instead of {dict(zip(names, w))}"
    return None


def main(folder: str, only: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    expected = oracle_sql()
    failed = 0
    for name, query in queries().items():
        if only and name not in only:
            continue
        start = time.time()
        df = query(spark, folder)
        if name in expected:
            found = difference(df, con, expected[name])
            verdict = found or "equal"
            failed += found is not None
        else:
            verdict = f"{df.count()} rows, no SQL"
        print(f"{name:28} {time.time() - start:6.1f} s  {verdict}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(main(where, sys.argv[2:]))
