"""Order-insensitive comparison of a Spark frame with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import math


def norm(v):
    if v is None:
        return "~null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) < 1e6 else f"{v:.2f}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(norm(r[i]) for i in order) for r in rows)


def same(df, con, sql):
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    b = rows_of(names, cur.fetchall())
    assert a[0] == b[0], (a[0], b[0])
    assert len(a[1]) == len(b[1]), (len(a[1]), len(b[1]))
    diff = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    assert not diff, diff[:3]
