"""The driver's entry, also without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "range_clip" in e.queries()


def test_entry(spark):
    import __spark_entry__ as e

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables")
    assert e.entry(spark).count() > 0


def test_without_the_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "wayline"):
        src = ROOT / p
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / p)
    shutil.rmtree(tmp_path / "wayline" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'range_clip' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "wayline").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "wayline").parts:
            assert "llm" not in p.read_text()
