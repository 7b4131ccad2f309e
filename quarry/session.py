"""The SparkSession the engine runs on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "quarry", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with ANSI arithmetic, UTC and adaptive execution.

    On a cluster leave `master` and `shuffle_partitions` unset: the cluster's
    settings hold, and adaptive execution coalesces what is too small.
    """
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
