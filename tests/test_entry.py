import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("verdure/llm", "tests/llm"), ("verdure/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_works_without_the_optional_parts(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for path in gone:
        shutil.rmtree(copy / path) if (copy / path).is_dir() else (copy / path).unlink()
    left = "verdure/llm" not in gone
    code = f"import __spark_entry__ as e; q = e.queries(); assert 'wide_export' in q and any(n.startswith('op') for n in q) == {left} and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True).returncode == 0
