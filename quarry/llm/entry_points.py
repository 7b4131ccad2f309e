"""The registered queries of this package: each operator on its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, lines, media, neardup, packing, repeats, rollups, toxicity, urls
from .common import materialise, scratch

#: A line on this many sites is boilerplate.
MIN_SITES = 10
#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents"), MIN_SITES)
    return kept.select("doc_id", "lines_total", "lines_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
b AS (SELECT line FROM l WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES})
SELECT doc_id, count(*) AS lines_total, count(b.line) AS lines_removed, md5(coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL), '')) AS kept_md5
FROM l LEFT JOIN b ON l.line = b.line GROUP BY doc_id
"""


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), 50, with_text=False).drop("spans", "kept")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), window=1024, with_ids=False).drop("ids")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"), keep=False).drop("media", "tensor")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), RULES).drop("logit")


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.format_pairs(chat.with_repeated_reply(chat.gather(_table(spark, sf_dir, "conversations"))))
    size = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("long")
    return out.select("conv_id", "prompt_turns", F.md5("prompt").alias("prompt_md5"), F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"), size("chosen_spans").alias("chosen_trained"), size("rejected_spans").alias("rejected_trained"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents go in by three batches under one tokenizer, one batch's counts are revised to the second and then restored, the second tokenizer's counts come in, a third is deleted and comes back, and batches are sent twice. The totals must be those of all documents under both."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    names = {"byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.tiktoken"), "byte_bpe_multi_50k": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}
    counts = rollups.count_tokens(docs, names).withColumn("part", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)))
    sums = materialise(counts.groupBy("part", *rollups.KEYS).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")), "token-sums")
    pick = lambda part, tok: sums.filter((F.col("part") == part) & (F.col("tokenizer") == tok)).select(*rollups.KEYS, "docs", "tokens")
    minus = lambda df: df.select(*rollups.KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
    a, b = names
    led = rollups.Ledger(spark, scratch(spark, "token-ledger"))
    for k in range(3):
        led.commit(f"insert-{k}", pick(k, a))
    led.commit("insert-0", pick(0, a))
    led.commit("revise-1", rollups.revised(pick(1, a), pick(1, b)))
    led.fold()
    led.commit("restore-1", pick(1, a))
    for k in (0, 2):
        led.commit(f"second-{k}", pick(k, b))
    led.commit("delete-2", minus(pick(2, a)))
    led.commit("again-2", pick(2, a))
    led.commit("revise-1", rollups.revised(pick(1, a), pick(1, b)))
    return led.totals()


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_repeats, op3_near_dedup, op4_packing, op5_toxicity, op6_media, op7_url_filter, op8_preference, op9_decontaminate, op10_token_rollup)}
ORACLE = {"op1_line_dedup": OP1_SQL, "op8_preference": chat.ORACLE}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE) | {"op7_url_filter": urls.oracle(RULES)}
