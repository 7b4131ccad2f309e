"""The library and its queries without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROBE = """
import __spark_entry__ as e
names = set(e.queries())
assert set(e.oracle_sql()) <= names and len(names) > 50, len(names)
assert not any(n == "pipeline" or n.startswith("op") and n[2].isdigit() for n in names), names
"""


@pytest.mark.parametrize("gone", [["quarry/llm", "tests/llm"], ["quarry/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for g in gone:
        p = tmp_path / "repo" / g
        shutil.rmtree(p) if p.is_dir() else p.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-B", "-c", PROBE], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120)
    assert not out.returncode, out.stderr[-2000:]
