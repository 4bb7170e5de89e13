"""Layout helpers: how many partitions a shuffle should have, and what may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def size_shuffles(*ledgers: DataFrame, target_bytes: int = 128 * 1024 * 1024) -> int:
    """Set the number of shuffle partitions from the size of the ledgers about to be processed.

    Adaptive execution merges partitions that turn out small, but it starts from this number and
    only splits skewed joins. The default of 200 would give half a terabyte per task for a ledger
    of 100 TB. Sizes are Catalyst's estimates, that is, file sizes after pruning; compressed text
    grows about threefold in a shuffle. Returns the number set.
    """
    spark = ledgers[0].sparkSession
    estimated = sum(
        int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
        for df in ledgers
    )
    cores = spark.sparkContext.defaultParallelism
    wanted = max(cores, -(-3 * estimated // target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted


# What a task reads of a shuffle of narrow rows. They compress about fifteenfold against their size in
# sorts and joins, so Spark's 64 MB would take a gigabyte of a task's memory.
NARROW_BYTES = 16 * 1024 * 1024


def narrow_tasks(spark: SparkSession, shuffled: int = 0) -> None:
    """Let tasks of this session read NARROW_BYTES of a shuffle at most, where ``shuffled`` bytes are dealt out.

    Adaptive execution merges small partitions up to the advisory size, and splits large ones for skew
    only; so there must be enough of them. A size that the session was given stays.
    """
    size, count = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, str(NARROW_BYTES))
    spark.conf.set(count, str(max(int(spark.conf.get(count)), -(-shuffled // NARROW_BYTES))))


# Rows of a table that is broadcast: some hundred megabytes of paths and numbers at most.
MOST_BROADCAST = 500_000


def broadcast_if_small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows; a larger one is joined by a shuffle.

    The rows are counted, so ``df`` should be a written table or a cheap step on one.
    """
    return F.broadcast(df) if df.count() <= most else df
