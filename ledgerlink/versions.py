"""Tables that are replaced as a whole: a folder per version and a file that names the current one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_CURRENT = "_current"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def published(spark: SparkSession, path: str) -> str:
    """The folder of the current version below ``path``; ``path`` itself if it has no versions."""
    where, fs = _at(spark, f"{path.rstrip('/')}/{_CURRENT}")
    if not fs.exists(where):
        return path
    stream = fs.open(where)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{path.rstrip('/')}/{name}"


def publish(write: Callable[[str], None], spark: SparkSession, path: str) -> str:
    """Let ``write`` fill a new folder below ``path``, then make it the current version.

    The version before is kept, older ones and remains of runs that died are deleted.
    """
    base = path.rstrip("/")
    before = published(spark, base)
    name = f"v-{uuid.uuid4().hex}"
    write(f"{base}/{name}")
    draft, fs = _at(spark, f"{base}/_draft-{name}")
    stream = fs.create(draft, True)
    stream.write(bytearray(name.encode()))
    stream.close()
    jvm = spark._jvm
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(draft), fs.makeQualified(_at(spark, f"{base}/{_CURRENT}")[0]), options)
    kept = {name, before.rsplit("/", 1)[-1], _CURRENT}
    for status in fs.listStatus(_at(spark, base)[0]):
        own = status.getPath().getName()
        if own not in kept and own.startswith(("v-", "_draft-v-")):
            fs.delete(status.getPath(), True)
    return f"{base}/{name}"
