"""The contract module works with and without the optional folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract
from parley.plans import registry

ROOT = Path(__file__).resolve().parents[1]


def test_every_query_with_sql_is_registered():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_imports_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "parley", tmp_path / "parley", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}
    )
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[0] == str(len(registry.QUERIES))


def test_nothing_else_imports_the_optional_parts():
    for path in (ROOT / "parley").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "parley.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
