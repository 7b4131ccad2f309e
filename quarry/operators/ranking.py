"""Window idioms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows of each group; Spark plans a partial group limit before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).filter(F.col(rank) <= n)


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One whole row for each group, the one with the greatest order columns: an aggregate, no sort."""
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])
