"""The library without the corpus operators: their folders and corpus_pipeline.py taken away."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import __spark_entry__ as e
names = set(e.queries())
assert names and not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert set(e.oracle_sql()) <= names and "alerts" in names
"""


def _without(tmp_path, *gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for path in gone:
        target = copy / path
        shutil.rmtree(target) if target.is_dir() else target.unlink(missing_ok=True)
    return subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, capture_output=True, text=True, timeout=120)


def test_folders_deleted_but_the_pipeline_left(tmp_path):
    done = _without(tmp_path, "heronwatch/llm", "tests/llm")
    assert done.returncode == 0, done.stderr


def test_all_deleted(tmp_path):
    done = _without(tmp_path, "heronwatch/llm", "tests/llm", "corpus_pipeline.py")
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_operators():
    own = [p for p in (ROOT / "heronwatch").rglob("*.py") if "llm" not in p.parts]
    assert own and not [p for p in own if "llm" in p.read_text()]
