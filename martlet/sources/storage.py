"""Reading and writing table sets on any Hadoop-compatible file system."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def require_tables(spark: SparkSession, directory: str, producers: Mapping[str, str]) -> None:
    """Fail before any job starts, naming the missing tables and the step that writes each."""
    missing = {t: p for t, p in producers.items() if not exists(spark, f"{directory}/{t}.parquet")}
    if missing:
        tables = ", ".join(sorted(missing))
        steps = ", ".join(sorted(set(missing.values())))
        raise FileNotFoundError(f"missing {len(missing)} tables ({tables}); run first: {steps}")


def write_parquet_set(tables: Mapping[str, DataFrame], directory: str,
                      partition_by: Mapping[str, Iterable[str]] | None = None) -> None:
    for name, frame in tables.items():
        writer = frame.write.mode("overwrite")
        keys = list((partition_by or {}).get(name, ()))
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{directory}/{name}.parquet")


def read_parquet_set(spark: SparkSession, directory: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{directory}/{name}.parquet") for name in names}


def export_table(frame: DataFrame, directory: str, name: str) -> dict:
    """Write one table as Parquet and as CSV (UTF-8 with a byte-order mark in the header).

    The rows are counted while Parquet is written; the CSV is made from the written Parquet, so
    the plan behind ``frame`` runs once.
    """
    counted = Observation(f"export_{name}")
    parquet_path = f"{directory}/{name}.parquet"
    frame.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(parquet_path)
    written = frame.sparkSession.read.schema(frame.schema).parquet(parquet_path)
    first, *rest = written.columns
    marked = written.withColumnRenamed(first, "﻿" + first)
    marked.write.mode("overwrite").options(header=True, encoding="UTF-8").csv(f"{directory}/{name}.csv")
    return {"table": name, "rows": counted.get["rows"], "columns": len(rest) + 1}


def result_report(frame: DataFrame, first: int = 12) -> dict:
    """First rows and total row count of a result."""
    return {"rows": frame.count(), "head": [r.asDict() for r in frame.limit(first).collect()]}
