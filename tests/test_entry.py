"""The entry module with and without the optional parts."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, pipeline_stays):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache", *([] if pipeline_stays else ["corpus_pipeline.py"])))
    assert not (copy / "chronolith" / "llm").exists()
    got = subprocess.run([sys.executable, "-c", NAMES], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert got.returncode == 0, got.stderr
    from chronolith import queries as core

    named, sql = (line.split() for line in got.stdout.strip().split("\n"))
    assert named == sorted(core.queries()) and sql == sorted(core.oracle_sql())
