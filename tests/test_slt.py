"""Golden SQL-logic cases: statements and queries with their exact results."""

from pathlib import Path

import pytest

from quarry import Engine
from quarry.slt import run

CASES = sorted((Path(__file__).parent / "slt").glob("*.slt"))


@pytest.mark.parametrize("path", CASES, ids=lambda p: p.stem)
def test_file(spark, tmp_path, path):
    e = Engine(spark, str(tmp_path))
    try:
        bad = run(e, path.read_text())
    finally:
        e.close()
    assert not bad, [(r.line, r.sql, r.expected, got) for r, got in bad]
