"""The driver's contract, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from corpus_engine.queries import QUERIES

ROOT = Path(entry.__file__).parent


def test_names():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(QUERIES) >= 60


def test_entry(spark):
    assert entry.entry(spark).columns == ["query", "chunk", "path", "score", "place"]


def test_stands_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "corpus_engine", tmp_path / "corpus_engine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e, bench, corpus_engine.engine; assert 'R7_hybrid_search' in e.queries(); assert not any(q.startswith('op') for q in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True).stderr == ""
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, capture_output=True, text=True)
    assert collected.returncode == 0, collected.stdout
    assert not any("engine.llm" in p.read_text() for p in (ROOT / "corpus_engine").rglob("*.py") if "llm" not in p.parts)
