"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Parquet, ORC, CSV, JSON or text; give csv and json a schema, so that no pass infers one."""
    r = spark.read.format(kind).options(**options)
    return (r.schema(schema) if schema is not None else r).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options: str) -> None:
    w = df.write.format(kind).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def compact(spark: SparkSession, src: str, dst: str, target_mb: int = 256) -> None:
    """Rewrites a table's small files: read splits are packed to target_mb, so no shuffle is needed."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", f"{target_mb}m")
    try:
        spark.read.parquet(src).write.mode("error").parquet(dst)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
