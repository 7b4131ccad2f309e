"""Joins beyond the equi-join kinds that DataFrame.join has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, values: list[str], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """For each left row the right values at the latest right_ts <= left_ts in the same key.

    One union and one window over the key: a single shuffle, no range join.
    Left rows without an earlier right row, with a null key or a null time get nulls.

    Where one key may hold a large part of the rows give `bucket`, a function of a time
    that never falls as the time grows (a month, a day). The window is then over key and
    bucket, so that a hot key is spread over tasks; each bucket begins with what the
    buckets before it end with, found by an aggregation to one row per key and bucket.
    """
    right = right.dropna(subset=[*by, right_ts])
    slot = bucket or (lambda ts: F.lit(0))
    pick = right.select(F.struct(*values)).schema[0].dataType
    tagged_l = left.withColumns({"_ts": F.col(left_ts), "_side": F.lit(1), "_slot": slot(F.col(left_ts)), "_pick": F.lit(None).cast(pick)})
    tagged_r = right.select(*by, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), slot(F.col(right_ts)).alias("_slot"), F.struct(*values).alias("_pick"))
    both = tagged_l.unionByName(tagged_r, allowMissingColumns=True)
    if bucket:
        marks = tagged_l.select(*by, "_ts", "_side", "_slot", "_pick").unionByName(tagged_r)
        ends = marks.groupBy(*by, "_slot").agg(F.max_by("_pick", F.when(F.col("_side") == 0, F.col("_ts"))).alias("_end"))
        earlier = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        begins = ends.select(*by, "_slot", F.lit(-1).alias("_side"), F.last("_end", ignorenulls=True).over(earlier).alias("_pick")).filter("_pick IS NOT NULL")
        both = both.unionByName(begins, allowMissingColumns=True)
    # a bucket's beginning has no time: nulls come first
    w = Window.partitionBy(*by, *(["_slot"] if bucket else [])).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_pick", F.last("_pick", ignorenulls=True).over(w))
    return both.filter("_side = 1").select(*left.columns, *[F.col(f"_pick.{v}").alias(v) for v in values])


def range_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, width: int) -> DataFrame:
    """Points inside half-open integer spans, by an equi-join on buckets of `width`."""
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return p.join(s, "_b").filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_b")
