"""The library stands without its optional part."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))
COUNT = "import __spark_entry__ as e; assert not e.LLM_QUERIES and not e.LLM_ORACLES; print(len(e.queries()), len(e.oracle_sql()))"


def test_entry_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    assert not (copy / "routelore" / "llm").exists()
    for with_pipeline in (True, False):
        if not with_pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
        assert done.returncode == 0, done.stderr
        assert done.stdout.split() == [str(len(entry.QUERIES)), str(len(entry.ORACLES))]
