"""The library without its training-data operators: in a copy that lacks their folders, everything else is still there."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(set(e.queries()) & {'pipeline', 'op1_revisits'}))"


@pytest.mark.parametrize("gone", [("brolga/llm", "corpus_pipeline.py"), ("brolga/llm",), ("corpus_pipeline.py",)])
def test_core_queries_without_llm(tmp_path, gone):
    from brolga.plans.registry import ORACLES, QUERIES

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "*.parquet"))
    for part in ("brolga/llm", "corpus_pipeline.py"):
        if part not in gone and (ROOT / part).exists():
            (shutil.copytree if (ROOT / part).is_dir() else shutil.copy)(ROOT / part, copy / part)
    env = {**os.environ, "PYTHONPATH": str(copy)}
    out = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split(maxsplit=2)
    if "brolga/llm" in gone or not (ROOT / "brolga/llm").exists():
        assert out == [str(len(QUERIES)), str(len(ORACLES)), "[]\n"]
    else:
        assert out[2] == "['op1_revisits']\n"
