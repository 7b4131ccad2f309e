"""Folders that driver and executors share, through Hadoop's file system API."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def rename_once(spark: SparkSession, src: str, dst: str) -> bool:
    """Renames a file or folder; False where dst is already there, which then stays as it is."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (src, dst))
    fs = a.getFileSystem(conf)
    a, b = fs.makeQualified(a), fs.makeQualified(b)
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), conf).rename(a, b, none)
        return True
    except Py4JJavaError:
        if not fs.exists(b):
            raise
        return False
