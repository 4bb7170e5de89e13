"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import remember, shared_folder

#: Characters of text that one step of a Python worker handles at a time; one longer text is a step.
STEP_CHARS = 300_000

#: Rows and bytes of a batch on its way to or from a Python worker. Spark's defaults suit narrow
#: rows; batches of texts would take hundreds of megabytes beside the executor's heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}

#: A word: a longest run of characters other than the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; Spark alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(texts: pa.Array, limit: int = STEP_CHARS) -> Iterator[list[str]]:
    """The texts of an Arrow array in runs of bounded total length; NULL counts as empty."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else []
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield [t or "" for t in texts.slice(start, i - start).to_pylist()]
            start, total = i, 0
        total += int(n) + 1
    if start < len(texts):
        yield [t or "" for t in texts.slice(start).to_pylist()]


def small_batches() -> None:
    """Let the session send texts to Python in small batches."""
    spark = SparkSession.getActiveSession()
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return df[f"`{name.replace('`', '``')}`"]


def n_words(text: Column) -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))), F.lit(0)).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of a document id as text; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn from."""
    return crc_of_id(doc_id) % 3 == 1


def tasks(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, only a local session may run, such as a test. ``scratch.release``
    deletes what is still there.
    """
    return remember(spark, f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}")


def written(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and a reader of the copy."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out.stored_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the copies that ``written`` made, once nothing reads them any more."""
    for df in frames:
        remove(df.sparkSession, df.stored_at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def id_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """Inner bounds of ranges with about equally many rows each; one pass over the column."""
    if parts < 2:
        return []
    got = df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted({int(x) for x in got})


def range_of(column: Column, bounds: list[int]) -> Column:
    """Number of bounds below the value: rows of a lower range have lower values; NULL is in range 0."""
    if not bounds:
        return F.lit(0)
    at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < column))
    return F.when(column.isNull(), 0).otherwise(at).cast("int")


#: Bits of a filter at most, as a power of two: 8 MB, whatever the number of values.
MOST_FILTER_BITS = 26
#: Bits that a value sets.
FILTER_HASHES = 5


class Filter:
    """A Bloom filter of 64-bit hashes; it may take a value for a member that is none.

    Its size follows the number of values up to 2 ** MOST_FILTER_BITS bits, so it may be broadcast.
    Beyond, more values pass, which costs time in what follows and changes no result.
    """

    def __init__(self, values: DataFrame, column: str):
        spark = values.sparkSession
        small_batches()
        self.bits = max(16, min(MOST_FILTER_BITS, (16 * values.count()).bit_length()))
        mask = (1 << self.bits) - 1
        high, low = F.shiftrightunsigned(F.col(column), 64 - self.bits), F.col(column).bitwiseAND(F.lit(mask))
        places = F.array(*[(high + i * low).bitwiseAND(F.lit(mask)) for i in range(FILTER_HASHES)])
        bit = F.col("place")
        got = (
            values.select(F.explode(places).alias("place"))
            .select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bit"))
            .groupBy("word")
            .agg(F.bit_or("bit").alias("bits"))
            .toArrow()
        )
        words = np.zeros(1 << (self.bits - 6), np.uint64)
        words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
        self.words = spark.sparkContext.broadcast(words)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """For each unsigned hash, whether it may be a member; for use in tasks."""
        words = self.words.value
        mask = np.uint64((1 << self.bits) - 1)
        high, low = hashes >> np.uint64(64 - self.bits), hashes & mask
        out = np.zeros(len(hashes), bool)
        at = np.arange(len(hashes))
        for i in range(FILTER_HASHES):
            bit = (high[at] + np.uint64(i) * low[at]) & mask
            at = at[(words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]
        out[at] = True
        return out

    def may_have(self, hashed: Column) -> Column:
        """The same for a column of hashes, none of them NULL."""

        @F.arrow_udf("boolean")
        def of(values: pa.Array) -> pa.Array:
            return pa.array(self.has(values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))

        return of(hashed)
