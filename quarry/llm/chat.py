"""Preference pairs from chosen and rejected conversations; DataFrame functions only.

The longest common prefix of turns (same role and text) of the two sides is
rendered once as the prompt; what follows on either side is its completion,
with the character spans that a loss may count: the text and end mark of
assistant turns. Both sides' turns are gathered by one aggregation, so turns
cross one shuffle and nothing is joined.

Edge cases: null roles and texts are empty; a null turn number sorts first and
turns with equal numbers by role and text; a null conversation id is a
conversation of its own, and ids may be of any type; a conversation on one side
only meets an empty one; equal sides give empty completions; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def _turn() -> Column:
    return F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def gather(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as array<struct<turn, role, text>>."""
    return turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(_turn())).alias("turns"))


def gather_pairs(chosen: DataFrame, rejected: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, chosen, rejected): the turns of both sides of each conversation, from two tables of turns."""
    side = lambda df, k: df.select(F.col(id_col).alias("conv_id"), F.lit(k).alias("side"), _turn().alias("t"))
    of = lambda k: F.sort_array(F.collect_list(F.when(F.col("side") == k, F.col("t"))))
    return side(chosen, 0).unionByName(side(rejected, 1)).groupBy("conv_id").agg(of(0).alias("chosen"), of(1).alias("rejected"))


def turn_text(x: Column) -> Column:
    return F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, turn_text), "")


def trained_spans(turns: Column) -> Column:
    """array<struct<start, end>>: where in the rendered turns an assistant's text and its end mark stand, in characters."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["role"]) + len("<||>\n")
        end = acc["at"] + F.length(turn_text(x))
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["role"] == "assistant", F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, none, step, lambda a: a["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """One row for each row of pairs (conv_id, chosen, rejected), as gather_pairs makes them; no shuffle.

    Columns: conv_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.
    """
    same = F.zip_with("chosen", "rejected", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    j = pairs.select("conv_id", "chosen", "rejected", F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int").alias("n"))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.size(c))
    j = j.select("conv_id", "n", F.slice("chosen", F.lit(1), F.col("n")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return j.select("conv_id", F.col("n").cast("long").alias("prompt_turns"), render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"), trained_spans(F.col("c")).alias("chosen_spans"), trained_spans(F.col("r")).alias("rejected_spans"))


def preference(chosen: DataFrame, rejected: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """format_pairs of two tables of turns (conversation id, turn, role, text). One row for each conversation id."""
    return format_pairs(gather_pairs(chosen, rejected, id_col))


def with_repeated_reply(convs: DataFrame) -> DataFrame:
    """Pairs from conversations (conv_id, turns) that have no rejected side: up to the last assistant turn, which says again what the assistant said before (nothing where it had not spoken); all of it where there is no assistant."""
    speaks = F.transform("turns", lambda x: x["role"] == "assistant")
    last = F.when(F.array_contains(speaks, True), F.size("turns") - F.array_position(F.reverse(speaks), F.lit(True)).cast("int") + 1)
    j = convs.select("conv_id", F.col("turns").alias("chosen"), last.alias("last"))
    before = F.slice("chosen", F.lit(1), F.col("last") - 1)
    j = j.select("*", F.when(F.col("last").isNotNull(), before).alias("before"))
    replies = F.filter("before", lambda x: x["role"] == "assistant")
    again = F.struct(F.get("chosen", F.col("last") - 1)["turn"].alias("turn"), F.lit("assistant").alias("role"), F.coalesce(F.try_element_at(replies, F.lit(-1))["text"], F.lit("")).alias("text"))
    return j.select("conv_id", "chosen", F.when(F.col("last").isNull(), F.col("chosen")).otherwise(F.concat("before", F.array(again))).alias("rejected"))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
la AS (SELECT conv_id, max(pos) AS lp FROM c WHERE role = 'assistant' GROUP BY conv_id),
pv AS (SELECT c.conv_id, arg_max(text, pos) AS x FROM c JOIN la USING (conv_id) WHERE role = 'assistant' AND pos < lp GROUP BY 1),
r AS (SELECT c.conv_id, role, text, pos FROM c LEFT JOIN la USING (conv_id) WHERE lp IS NULL OR pos < lp UNION ALL SELECT la.conv_id, 'assistant', coalesce(x, ''), lp FROM la LEFT JOIN pv USING (conv_id)),
m AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(min(coalesce(c.pos, r.pos)) FILTER (WHERE c.pos IS NULL OR r.pos IS NULL OR c.role <> r.role OR c.text <> r.text) - 1, max(c.pos)) AS n FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.pos = r.pos GROUP BY 1),
g AS (SELECT conv_id, pos, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s, length(text) + 8 AS k FROM c),
h AS (SELECT conv_id, pos, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s, length(text) + 8 AS k FROM r),
a AS (SELECT m.conv_id, n, string_agg(s, '' ORDER BY pos) FILTER (WHERE pos <= n) AS p, string_agg(s, '' ORDER BY pos) FILTER (WHERE pos > n) AS c, sum(k) FILTER (WHERE pos > n AND role = 'assistant') AS ck FROM m LEFT JOIN g USING (conv_id) GROUP BY 1, 2),
b AS (SELECT m.conv_id, string_agg(s, '' ORDER BY pos) FILTER (WHERE pos > n) AS r, sum(k) FILTER (WHERE pos > n AND role = 'assistant') AS rk FROM m LEFT JOIN h USING (conv_id) GROUP BY 1)
SELECT conv_id, n AS prompt_turns, md5(coalesce(p, '')) AS prompt_md5, md5(coalesce(c, '')) AS chosen_md5, md5(coalesce(r, '')) AS rejected_md5, CAST(coalesce(ck, 0) AS BIGINT) AS chosen_trained, CAST(coalesce(rk, 0) AS BIGINT) AS rejected_trained FROM a JOIN b USING (conv_id)
"""
