"""The rest of the library without the corpus subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("elsewhere", [None, str(ROOT)])
@pytest.mark.parametrize("gone", [("quarry/llm", "tests/llm"), ("quarry/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_the_corpus_subpackage(tmp_path, gone, elsewhere):
    """Also where another, whole checkout is on the path."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        else:
            (copy / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'a1_status_counts' in n and set(e.oracle_sql()) <= set(n); assert 'pipeline' not in n"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": elsewhere} if elsewhere else {})
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)


def test_whole_checkout_has_the_pipeline():
    code = "import __spark_entry__ as e; n = e.queries(); assert {'pipeline', 'op1_secret_scan'} <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    own = [p for p in (ROOT / "quarry").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert own and not [p for p in own if "quarry.llm" in p.read_text() or "corpus_pipeline" in p.read_text()]
