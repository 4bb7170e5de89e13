"""Intermediate tables in the folder that the cluster shares.

A multi-step operator reads the result of a step more than once. Writing the step as Parquet cuts
the lineage, survives the loss of executors, and lets each reader prune columns and partitions.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir`` or of ``setCheckpointDir``.

    Only a local session, such as a test, may go without either and gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    chosen = spark.sparkContext.getCheckpointDir()
    if chosen:
        return chosen
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlink-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once and return a reader of the copy, with the same column order."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark).rstrip('/')}/ledgerlink-{app}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.setdefault(app, []).append(path)
    # The schema is given, so that an empty result reads back and no file is opened to infer it.
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def remember(spark: SparkSession, path: str) -> str:
    """Let ``release`` delete this folder, too."""
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application; results not yet read become invalid."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        target = jvm.org.apache.hadoop.fs.Path(p)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)
