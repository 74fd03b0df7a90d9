"""The driver's entry points, with and without the corpus operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print('NAMES', *e.queries()); print('SQL', *e.oracle_sql())"


def names(folder) -> dict[str, set[str]]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SAY], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout
    return {line.split()[0]: set(line.split()[1:]) for line in out.splitlines() if line.startswith(("NAMES", "SQL"))}


@pytest.mark.parametrize("gone", [("timberline/llm", "tests/llm"), ("timberline/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.parquet"))
    for name in gone:
        path = tmp_path / "copy" / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    found = names(tmp_path / "copy")
    assert "level_histogram" in found["NAMES"] and "pipeline" not in found["NAMES"]
    assert not {n for n in found["NAMES"] if n.startswith("op")}
    assert found["SQL"] <= found["NAMES"]


def test_every_oracle_has_a_query():
    found = names(ROOT)
    assert found["SQL"] <= found["NAMES"]
