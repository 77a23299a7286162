"""Tables in the folder that the cluster shares: they cut lineage and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it.

    Where that is unset, a temporary one, but only if all of Spark runs in this process, as in tests: elsewhere executors would not see each other's files.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if top:
        return top
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='glyphloom')}"
    return _LOCAL[context.applicationId]


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the session's JVM ends."""
    path = f"{shared_folder(spark)}/glyphloom-{name}-{uuid.uuid4().hex}"
    at, store = _path(spark, path)
    store.deleteOnExit(at)
    return path


#: Spark deletes the shuffles of a classic session's command when it is done, where this is set.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to scratch() and read again. Unlike checkpoint() it computes df once. Its shuffles are deleted with the write, as nothing reads them any more, and don't wait for the driver's garbage collection."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANED, before) if before is not None else spark.conf.unset(_CLEANED)
    made = spark.read.schema(df.schema).parquet(path)
    made._glyphloom_path = path
    return made


def spread(scan: DataFrame) -> DataFrame:
    """The rows of some files in as many parts as there are tasks at once, where the files make fewer. Large tables have enough, and aren't shuffled. Rows go by a hash of all their columns, so that no value of one gathers them."""
    tasks = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= tasks else scan.repartition(tasks, F.xxhash64(*(F.col(f"`{c.replace('`', '``')}`") for c in scan.columns)))


def dropped(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    discarded(df.sparkSession, df._glyphloom_path)


def discarded(spark: SparkSession, path: str) -> None:
    """Delete what lies at a path of scratch()."""
    at, store = _path(spark, path)
    store.delete(at, True)
