"""The rest stands without the training-data operators."""

import pathlib
import shutil
import subprocess
import sys

import pytest

REPO = pathlib.Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'hybrid_search' in q; print(*sorted(q))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_training_data_operators(tmp_path, pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    names = done.stdout.split()
    assert "pipeline" not in names and not [n for n in names if n.startswith("op")]


def test_other_missing_modules_are_errors(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    (copy / "corpus_pipeline.py").write_text("import no_such_module_here\n")
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "no_such_module_here" in done.stderr
