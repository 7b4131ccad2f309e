"""Cross-site line dedup with HyperLogLog spread, in DataFrame functions only.

A line is boilerplate if it stands on at least `min_sites` distinct sites.
Sketches of the sites of each line hash merge by aggregation (partial before
the shuffle, so a line on a third of all documents sends one sketch a task).
Only lines whose estimate is near the threshold get an exact distinct count;
the rest are far enough from it that the sketch's error cannot matter.

Edge cases: a null text is empty; a null site is no site; lines of spaces only
are never boilerplate; an empty table gives no rows; repeated rows are treated
alike; a document whose lines all go keeps an empty text. Other columns pass
through unchanged, whatever their names; the two new columns get underscores
added where docs has columns of their names, in upper or lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, materialise

LG_K = 12  # 4096 registers: a standard error of 1.6 %


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _keys(line: Column) -> list[Column]:
    """128 bits."""
    return [F.xxhash64(line).alias("__h1"), F.xxhash64(F.lit(7), line).alias("__h2")]


def spread(docs: DataFrame, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(__h1, __h2, estimate): for each line's hash about how many sites have it."""
    each = docs.select(F.col(site_col).cast("string").alias("__site"), F.explode(F.array_distinct(_lines(F.col(text_col)))).alias("__line")).filter(F.trim("__line") != "")
    return each.select("__site", *_keys(F.col("__line"))).groupBy("__h1", "__h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("__site", LG_K)).alias("estimate"))


def boilerplate(docs: DataFrame, min_sites: int, text_col: str = "text", site_col: str = "source", margin: float = 0.25) -> DataFrame:
    """(__h1, __h2) of lines on at least min_sites sites. margin: how far from the threshold, in parts, a count is made exact; 15 standard errors by default."""
    low, high = min_sites * (1 - margin), min_sites * (1 + margin)
    found = materialise(spread(docs, text_col, site_col).filter(F.col("estimate") >= low), "line-spread")
    near = found.filter(F.col("estimate") <= high).select("__h1", "__h2")
    each = docs.select(F.col(site_col).cast("string").alias("__site"), F.explode(F.array_distinct(_lines(F.col(text_col)))).alias("__line")).filter(F.trim("__line") != "").select("__site", *_keys(F.col("__line")))
    exact = each.join(near, ["__h1", "__h2"], "left_semi").distinct().groupBy("__h1", "__h2").agg(F.count("__site").alias("__n")).filter(F.col("__n") >= min_sites)
    return found.filter(F.col("estimate") > high).select("__h1", "__h2").unionByName(exact.select("__h1", "__h2"))


def dedup_lines(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", margin: float = 0.25) -> DataFrame:
    """docs with boilerplate lines taken out of text_col, and two columns more: lines_total, lines_removed."""
    bad = boilerplate(docs, min_sites, text_col, site_col, margin)
    total, removed, r1, r2, gone = free(docs.columns, "lines_total", "lines_removed", "row_1", "row_2", "gone")
    own = lambda c: F.col(f"`{c}`")
    row = [F.xxhash64(own(id_col), own(text_col)).alias(r1), F.xxhash64(F.lit(7), own(id_col), own(text_col)).alias(r2)]
    each = docs.select(*row, F.posexplode(_lines(own(text_col))).alias("__pos", "__line")).select(r1, r2, "__pos", *_keys(F.col("__line")))
    drop = each.join(bad, ["__h1", "__h2"], "left_semi").groupBy(r1, r2).agg(F.collect_set("__pos").alias(gone))
    tagged = docs.select("*", *row).join(drop, [r1, r2], "left")
    kept = F.array_join(F.filter(_lines(own(text_col)), lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    return tagged.select(
        *[(F.when(F.col(gone).isNull(), own(c)).otherwise(kept).alias(c) if c == text_col else own(c)) for c in docs.columns],
        F.size(_lines(own(text_col))).cast("long").alias(total),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed),
    )
