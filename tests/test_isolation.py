"""What is left without the text operators still works."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("ferrograph/llm", "tests/llm", "corpus_pipeline.py"), ("ferrograph/llm", "tests/llm"), ("corpus_pipeline.py",), ()])
def test_queries_without_some_parts(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 60; print('pipeline' in q, any(n.startswith('op1_') for n in q))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    has_llm = (copy / "ferrograph/llm").is_dir()
    assert said.stdout.split() == [str(has_llm and (copy / "corpus_pipeline.py").exists()), str(has_llm)]
