"""The optional subpackage can go: nothing else needs it."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_it(tmp_path, pipeline):
    """The whole repository but both folders, with the pipeline's file and without: it loads, and tests pass."""
    gone = ["llm", "__pycache__", ".git", ".pytest_cache"] + ["corpus_pipeline.py"] * (not pipeline)
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(*gone))
    root = tmp_path / "repo"
    assert (root / "corpus_pipeline.py").exists() == pipeline and not (root / "millrace" / "llm").exists() and not (root / "tests" / "llm").exists()
    (root / "millrace" / "llm" / "__pycache__").mkdir(parents=True)  # what deleting may leave behind
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    env = os.environ | {"PYTHONPATH": str(root), "PYTHONDONTWRITEBYTECODE": "1"}
    run = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, env=env)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout.strip().split()[-1]) > 90
    if pipeline:
        return
    run = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_queries.py::test_entry", "tests/test_operators.py"], cwd=root, capture_output=True, text=True, env=env)
    assert run.returncode == 0, run.stdout[-2000:]
