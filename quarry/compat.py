"""SQL spellings that Spark lacks or types otherwise: rewritten before parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def register_functions(spark: SparkSession) -> None:
    """SQL functions (inlined by Catalyst, no UDF)."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION starts_with(a STRING, b STRING) RETURNS BOOLEAN RETURN startswith(a, b)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ends_with(a STRING, b STRING) RETURNS BOOLEAN RETURN endswith(a, b)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ceil_float(a DOUBLE) RETURNS DOUBLE RETURN CAST(ceil(a) AS DOUBLE)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION floor_float(a DOUBLE) RETURNS DOUBLE RETURN CAST(floor(a) AS DOUBLE)")


#: Arrow's names of types, as arrow_cast takes them.
ARROW = {"Boolean": "BOOLEAN", "Int16": "SMALLINT", "Int32": "INT", "Int64": "BIGINT", "Float32": "FLOAT", "Float64": "DOUBLE", "Utf8": "STRING", "Binary": "BINARY", "Date32": "DATE"}
_UNITS = {"Second": "timestamp_seconds({})", "Millisecond": "timestamp_millis({})", "Microsecond": "timestamp_micros({})", "Nanosecond": "timestamp_micros(({}) DIV 1000)"}


def rewrite(sql: str) -> str:
    """Outside of string literals: VARCHAR casts, CEIL/FLOOR to double, POWER by its arguments' types, arrow_cast."""
    texts: list[str] = []

    def hide(m: re.Match) -> str:
        texts.append(m[0])
        return f"\x00{len(texts) - 1}\x00"

    p = re.sub(r"'(?:[^']|'')*'", hide, sql)
    p = re.sub(r"\bAS\s+VARCHAR\b(?:\s*\(\s*\d+\s*\))?", "AS STRING", p, flags=re.I)
    p = re.sub(r"\bCEIL(?:ING)?\s*\(", "ceil_float(", p, flags=re.I)
    p = re.sub(r"\bFLOOR\s*\(", "floor_float(", p, flags=re.I)
    p = _calls(p, r"POW(?:ER)?", _power)
    p = _calls(p, "arrow_cast", lambda args: _arrow_cast(args, texts))
    return re.sub("\x00(\\d+)\x00", lambda m: texts[int(m[1])], p)


def _calls(text: str, name: str, fn) -> str:
    """Replaces calls of a function, inner ones first, by fn(arguments); as it stands where fn gives None."""
    done = len(text)
    while m := next((m for m in reversed(list(re.finditer(rf"(?<![\w.]){name}\s*\(", text, re.I))) if m.start() < done), None):
        depth, cuts = 1, [m.end()]
        for i in range(m.end(), len(text)):
            depth += (text[i] in "([") - (text[i] in ")]")
            if not depth:
                break
            if text[i] == "," and depth == 1:
                cuts.append(i + 1)
        else:
            return text  # not closed: the parser says so
        args = [text[a:z].strip() for a, z in zip(cuts, [*(c - 1 for c in cuts[1:]), i])]
        done = m.start()
        if (new := fn(args)) is not None:
            text = text[: m.start()] + new + text[i + 1 :]
    return text


def _power(args: list[str]) -> str | None:
    """Integers give an integer, anything else a double. typeof is known when the query is analysed, so the result has one type."""
    if len(args) != 2:
        return None
    a, b = args
    if re.fullmatch(r"-?\d+", a) and re.fullmatch(r"\d+", b):
        return f"CAST(power({a}, {b}) AS BIGINT)"
    return f"variant_get(CAST(power({a}, {b}) AS VARIANT), '$', if(typeof(({a}) * ({b}) * 1L) = 'bigint', 'bigint', 'double'))"


def _arrow_cast(args: list[str], texts: list[str]) -> str | None:
    if len(args) != 2 or not (m := re.fullmatch("\x00(\\d+)\x00", args[1])):
        return None
    kind = texts[int(m[1])][1:-1]
    if kind in ARROW:
        return f"CAST({args[0]} AS {ARROW[kind]})"
    if u := re.fullmatch(r"Timestamp\((\w+), None\)", kind):
        return f"CAST({_UNITS[u[1]].format(args[0])} AS TIMESTAMP_NTZ)" if u[1] in _UNITS else None
    return None


def power(base: Column, exponent: Column, base_type: T.DataType, exponent_type: T.DataType) -> Column:
    """Integers give an integer, anything else a double."""
    out = F.pow(base, exponent)
    return out.cast("bigint") if isinstance(base_type, _INTEGRAL) and isinstance(exponent_type, _INTEGRAL) else out


def ceil(c: Column) -> Column:
    return F.ceil(c).cast("double")


def floor(c: Column) -> Column:
    return F.floor(c).cast("double")


def safe_cast(c: Column, kind: str) -> Column:
    """Null where the value does not parse, instead of an ANSI error."""
    return c.try_cast(kind)
