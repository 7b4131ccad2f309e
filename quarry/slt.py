"""A reader and comparator for sqllogictest files."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from decimal import Decimal

from .engine import Engine
from .errors import EngineError


@dataclass
class Record:
    kind: str  # "ok", "error" or "query"
    sql: str
    sort: str = "nosort"
    expected: list[str] = field(default_factory=list)
    line: int = 0


def parse(text: str) -> list[Record]:
    out: list[Record] = []
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        head = lines[i].split()
        if not head or head[0].startswith("#") or head[0] not in ("statement", "query"):
            i += 1
            continue
        at = i + 1
        i += 1
        sql, expected = [], []
        while i < len(lines) and lines[i].strip() and lines[i].strip() != "----":
            sql.append(lines[i])
            i += 1
        if i < len(lines) and lines[i].strip() == "----":
            i += 1
            while i < len(lines) and lines[i].strip():
                expected.append(lines[i])
                i += 1
        if head[0] == "statement":
            out.append(Record("error" if head[1:2] == ["error"] else "ok", "\n".join(sql), line=at))
        else:
            out.append(Record("query", "\n".join(sql), head[2] if len(head) > 2 else "nosort", expected, at))
    return out


def shown(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, Decimal):
        v = float(v) if v.as_tuple().exponent else int(v)
    if isinstance(v, float):
        return f"{v:.1f}" if math.isfinite(v) and v == int(v) and abs(v) < 1e15 else repr(v)
    return str(v)


def run(engine: Engine, text: str) -> list[tuple[Record, list[str]]]:
    """Runs all records; returns those that differ, with what came out."""
    bad = []
    for r in parse(text):
        try:
            got = [" ".join(shown(v) for v in row) for row in engine.sql(r.sql).collect()]
        except EngineError as e:
            if r.kind != "error":
                bad.append((r, [f"{e.code}: {str(e)[:200]}"]))
            continue
        if r.kind == "error":
            bad.append((r, ["no error"]))
        elif r.kind == "query":
            a, b = [" ".join(x.split()) for x in got], [" ".join(x.split()) for x in r.expected]
            if r.sort == "rowsort":
                a, b = sorted(a), sorted(b)
            if a != b:
                bad.append((r, got))
    return bad
