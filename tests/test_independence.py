"""The library stands without its corpus part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_corpus_part():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tessera.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path


def test_entry_imports_without_it(tmp_path):
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(q) == set(e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
