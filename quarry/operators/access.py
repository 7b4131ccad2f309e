"""Index-style access, left to Parquet statistics and pushed filters.

A layout sorted by the key (`clustered`) gives row groups narrow key ranges, so
equality, range and prefix filters skip most of a table.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def equal(df: DataFrame, key: str | Column, value: Any) -> DataFrame:
    return df.filter((F.col(key) if isinstance(key, str) else key) == F.lit(value))


def in_range(df: DataFrame, key: str, start: Any = None, end: Any = None) -> DataFrame:
    """Half-open: start <= key < end; None leaves a side open."""
    if start is not None:
        df = df.filter(F.col(key) >= F.lit(start))
    return df if end is None else df.filter(F.col(key) < F.lit(end))


def prefix(df: DataFrame, key: str, start: str, reverse: bool = False) -> DataFrame:
    """Keys that begin with start, in byte order of the key."""
    c = F.col(key)
    return df.filter(c.startswith(start)).orderBy(c.desc() if reverse else c.asc())


def min_with_prefix(df: DataFrame, key: str, start: str) -> DataFrame:
    """The smallest key with this prefix, one row; null where there is none."""
    return df.filter(F.col(key).startswith(start)).agg(F.min(key).alias(key))


class Cursor:
    """Rows in the order of unique keys, some at a time.

    Each step filters on the keys past the last row and takes the first ones that
    remain, so no step sorts a table or holds more than it returns; on a clustered
    layout the filter on the first key skips what is behind. Rows with a null key
    are left out, as an index has none.
    """

    def __init__(self, df: DataFrame, *keys: str, reverse: bool = False):
        self.keys, self.reverse = keys, reverse
        self.rows = df.dropna(subset=list(keys))
        self.seek_to_first()

    def seek_to_first(self) -> None:
        self._at: tuple | None = None

    def seek(self, *key: Any) -> None:
        """The next row is the first at or past the key; fewer values than keys mean any for the rest."""
        self._at, self._past = key, False

    def next(self, n: int = 1) -> list[Row]:
        """The next n rows, fewer at the end."""
        df = self.rows
        if self._at is not None:
            names = self.keys[: len(self._at)]
            here, there = F.struct(*names), F.struct(*(F.lit(v).cast(self.rows.schema[k].dataType).alias(k) for k, v in zip(names, self._at)))
            first, edge = F.col(names[0]), F.lit(self._at[0])
            if self.reverse:
                df = df.filter(first <= edge).filter(here < there if self._past else here <= there)
            else:
                df = df.filter(first >= edge).filter(here > there if self._past else here >= there)
        out = df.orderBy(*(F.col(k).desc() if self.reverse else F.col(k).asc() for k in self.keys)).limit(n).collect()
        if out:
            self._at, self._past = tuple(out[-1][k] for k in self.keys), True
        return out


def clustered(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Rows laid out for index access by keys: ranges over partitions, sorted inside."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; rows with a null key count as distinct."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
