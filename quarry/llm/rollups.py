"""Token counts as delta-maintained rollups.

A ledger is a folder of batches. A batch holds additive rows: (keys..., docs,
tokens) with signs, so an insert adds, a delete subtracts, and a revised count
is a delete of the old and an insert of the new. A batch is written under a name
of its own and then renamed to its id, which succeeds for one writer only and
shows all of it or nothing: a repeated, retried or racing commit of an id
changes nothing. Totals are sums over visible batches. `fold` replaces those
that it has listed by one snapshot, which holds their list and their sums and
appears by one rename too; a batch that comes in meanwhile is in neither.

Edge cases: null texts count zero tokens; null sources, languages and ids form
groups of their own; repeated rows count as often as they occur; an empty
table makes an empty batch, which is committed all the same; other columns are
not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, hadoop, publish, slices
from .tokens import chunks, encoder

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens): each text's tokens under each named vocabulary file."""

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                per = np.zeros((len(tokenizers), b.num_rows), np.int64)
                for c in chunks(b.column(1).to_pylist()):  # one split serves all vocabularies
                    for out, path in zip(per, tokenizers.values()):
                        encoder(path, False).add_counts(c, out)
                for name, out in zip(tokenizers, per):
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([name] * b.num_rows, pa.string()), pa.array(out)], names=["doc_id", "source", "lang", "tokenizer", "tokens"])

    src = docs_of(docs, id_col, text_col, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    return src.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as an additive delta: +1 for inserts, -1 for deletes."""
    return counts.groupBy(*KEYS).agg((F.count(F.lit(1)) * sign).alias("docs"), (F.sum("tokens") * sign).alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The delta that replaces old deltas' rows by new ones."""
    return old.select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")).unionByName(new.select(*KEYS, "docs", "tokens"))


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self) -> list[str]:
        fs, root = hadoop(self.spark, self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []

    def _visible(self) -> tuple[str | None, list[str], list[str]]:
        """(newest snapshot, batches that it has, batches that it has not), by one listing."""
        names = self._names()
        batches = [n for n in names if n.startswith("batch=")]
        snap = max((n for n in names if n.startswith("snapshot=")), key=lambda n: int(n.split("=")[1]), default=None)
        has = {r[0] for r in self.spark.read.text(f"{self.path}/{snap}/batches").collect()} if snap else set()
        return snap, sorted(has), [n for n in batches if n not in has]

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Writes a batch once; False where it is there already, folded into a snapshot or not."""
        if not batch or "/" in batch:
            raise ValueError(f"bad batch id {batch!r}")
        if f"batch={batch}" in self._names():
            return False
        rows = delta.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        own = f"{self.path}/_new-{uuid.uuid4().hex}"
        rows.write.parquet(own)
        return publish(self.spark, own, f"{self.path}/batch={batch}")

    def _sums(self, snap: str | None, rest: list[str]) -> DataFrame:
        folders = [*([f"{snap}/sums"] if snap else []), *rest]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        # exact folders are read, so their names are no columns
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{n}" for n in folders])
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """Docs and tokens for each source, language and tokenizer; groups that sum to nothing are left out."""
        snap, _, rest = self._visible()
        return self._sums(snap, rest)

    def fold(self) -> bool:
        """Writes a snapshot of the batches visible now; the batches stay, so they are still not committed again. False where another fold was first."""
        snap, has, rest = self._visible()
        own = f"{self.path}/_new-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(n,) for n in [*has, *rest]], "value string").coalesce(1).write.text(f"{own}/batches")
        self._sums(snap, rest).write.parquet(f"{own}/sums")
        return publish(self.spark, own, f"{self.path}/snapshot={int(snap.split('=')[1]) + 1 if snap else 0}")
