"""Folders that driver and executors share, and small helpers for Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import rename_once

MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where no checkpoint folder is set at all, one is made in local mode only: a cluster has to name a shared one."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(where)
        return where.rstrip("/")
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what materialise wrote for these frames; nothing may read them any more."""
    for df in frames:
        fs, p = hadoop(df.sparkSession, df.scratch_path)
        fs.delete(p, True)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores added until no column has them, in upper or lower case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def limit_of(rows: int) -> int:
    """How many rows of one key a task may get: a 10,000th of all, and 1,000 at least."""
    return max(1000, rows // 10_000)


def spread(rows: DataFrame, table: DataFrame, key: str | list[str], limit: int) -> DataFrame:
    """rows joined with a table that has one row for each key and its number of rows as cnt.

    Keys with more than `limit` rows (see limit_of: 10,000 of them at most) are broadcast
    and their rows not moved, so that no key's rows meet in one task.
    """
    key = [key] if isinstance(key, str) else key
    hot = table.filter(F.col("cnt") > limit)
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(table.filter(F.col("cnt") <= limit), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def hadoop(spark: SparkSession, path: str):
    """Hadoop's file system and path objects for path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(spark: SparkSession, src: str, dst: str) -> bool:
    """Renames a folder that holds files, at once or not at all; False, and src is deleted, where dst is already there."""
    done = rename_once(spark, src, dst)
    if not done:
        fs, p = hadoop(spark, src)
        fs.delete(p, True)
    return done


def docs_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator needs, under fixed names; a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def bytes_of(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and its n + 1 offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    big = col.cast(pa.large_binary())
    bufs = big.buffers()
    off = np.frombuffer(bufs[1], "<i8", len(big) + 1 + big.offset)[big.offset :]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for all i end to end."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 8_000_000):
    """Parts of a batch with about `limit` bytes of text each; a longer text stands alone."""
    col = batch.column(batch.schema.get_field_index(column))
    _, off = bytes_of(col)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
