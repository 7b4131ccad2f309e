"""The engine's ten scalar types and their SQL spellings."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from .errors import SyntaxProblem

TYPES: dict[str, T.DataType] = {
    "SMALLINT": T.ShortType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "REAL": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "TEXT": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "BYTEA": T.BinaryType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "DATE": T.DateType(),
}

ALIASES = {
    "INT2": "SMALLINT", "INTEGER": "INT", "INT4": "INT", "INT8": "BIGINT", "FLOAT": "REAL", "FLOAT4": "REAL", "FLOAT8": "DOUBLE", "DOUBLE PRECISION": "DOUBLE",
    "VARCHAR": "TEXT", "CHAR": "TEXT", "CHARACTER": "TEXT", "CHARACTER VARYING": "TEXT", "STRING": "TEXT", "BOOL": "BOOLEAN", "BYTES": "BYTEA", "BLOB": "BYTEA", "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP",
}
_SPELLING = re.compile(r"\s*([A-Za-z]\w*(?:\s+[A-Za-z]\w*)*)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*")


def ddl_type(word: str) -> T.DataType:
    """The Spark type of a DDL spelling, any case; lengths of texts are accepted and not enforced, DECIMAL and NUMERIC keep theirs. Unknown words are syntax problems."""
    m = _SPELLING.fullmatch(word)
    key = " ".join(m[1].upper().split()) if m else ""
    if key in ("DECIMAL", "NUMERIC"):
        digits, scale = int(m[2] or 18), int(m[3] or 0)
        if not scale <= digits <= 38 or not digits:
            raise SyntaxProblem(f"bad digits in {word!r}")
        return T.DecimalType(digits, scale)
    key = ALIASES.get(key, key)
    if key not in TYPES or (m[2] and key not in ("TEXT", "TIMESTAMP", "REAL")):
        raise SyntaxProblem(f"unknown type {word!r}")
    return TYPES[key]


def field(name: str, word: str, nullable: bool = True) -> T.StructField:
    return T.StructField(name.lower(), ddl_type(word), nullable)
