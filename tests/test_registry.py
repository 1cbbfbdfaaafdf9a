"""The registry with and without the optional modules."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), len(s), any(n.startswith('op') for n in q))"


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "the pipeline"])
def test_queries_are_there_without_the_optional_modules(tmp_path, left):
    shutil.copytree(ROOT / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left == "an empty folder":
        (tmp_path / "plumbline" / "llm" / "__pycache__").mkdir(parents=True)
    if left == "the pipeline" and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)
    assert done.returncode == 0, done.stderr
    n, with_sql, optional = done.stdout.split()
    assert int(n) > 100 and int(with_sql) >= int(n) - 1 and optional == "False"
