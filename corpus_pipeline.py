"""From raw documents to packed training sequences.

Each stage takes all rows that the one before kept; between stages the rows are
written to the shared folder as Parquet and read again, so a lost executor costs
no earlier stage; a stage's rows are deleted when the next one's are written. All
stages but the last return the columns of documents.

Edge cases: a null text is empty in every stage. Toxicity scores rows with a null
id like any other. Line dedup counts a null source as no site. Near-dedup and
decontamination keep rows with a null id; rows with equal id and text stay or go
together. Packing gives an empty document one piece, its end token. Null labels
and benchmark texts are left out. An empty documents table gives no pieces.
Columns beside doc_id, text, source and n_chars pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, lines, neardup, packing, toxicity
from quarry.llm.common import discard, materialise

MIN_SITES = 10
TOXIC_FROM = 0.5
WINDOW = 1024


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labels of documents that are here."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model, TOXIC_FROM)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sources; n_chars follows the text."""
    kept = lines.dedup_lines(docs, MIN_SITES)
    removed = F.col(kept.columns[-1])
    return kept.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least id."""
    return neardup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item, edited or not."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids."""
    return packing.pack(docs, window=WINDOW)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("near_dedup", drop_near_duplicates), ("decontamination", drop_benchmark_leaks), ("packing", pack)]

#: Trained scores, sketches and token ids have no SQL form; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
