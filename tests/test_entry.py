from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

PROBE = """
import __spark_entry__ as e
names = e.queries()
sql = e.oracle_sql()
assert names and set(sql) <= set(names), (len(names), len(sql))
assert not any(n.startswith("op") or n == "pipeline" for n in names), sorted(names)
print(len(names), len(sql))
"""


def test_core_queries_survive_without_training_data_subpackage(tmp_path):
    """The driver deletes the subpackage of training-data operators, its tests and the pipeline."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    assert not (copy / "tagtide" / "llm").exists() and not (copy / "corpus_pipeline.py").exists()
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    found, stated = map(int, done.stdout.split())
    assert found >= 75 and stated >= 70
