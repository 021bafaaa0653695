"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark drops a query's shuffle files when the query ends; a written table no longer needs them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where it is unset (tests), the checkpoint folder or a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="martlet-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def table(df: DataFrame, what: str) -> DataFrame:
    """`df` written as Parquet to a new path of the shared folder and read again: later steps survive lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    written = spark.read.schema(df.schema).parquet(path)
    written.martlet_path = path
    return written


def drop(*tables: DataFrame) -> None:
    """Delete tables made by `table` that nothing reads any more."""
    for written in tables:
        spark = written.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(written.martlet_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
