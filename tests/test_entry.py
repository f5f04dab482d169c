"""The driver's contract, with and without the optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q) and "q01_extract_counts" in q and "q41_documents_issues" in o
print(sum(n.startswith("op") for n in q), "pipeline" in q, sum(n.startswith("q") for n in q))
"""


def counts(folder: Path) -> tuple[int, bool, int]:
    found = subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, check=False, timeout=300)
    assert found.returncode == 0, found.stderr
    ops, pipeline, others = found.stdout.split()
    return int(ops), pipeline == "True", int(others)


def copied(folder: Path) -> Path:
    shutil.copytree(TOP, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    return folder


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("leave_folder", [True, False])
def test_without_the_optional_subpackage(tmp_path, pipeline, leave_folder):
    top = copied(tmp_path / "repo")
    with_all = counts(TOP)
    shutil.rmtree(top / "assayspark/llm", ignore_errors=True)
    shutil.rmtree(top / "tests/llm", ignore_errors=True)
    if leave_folder:
        (top / "assayspark/llm/__pycache__").mkdir(parents=True)
    if not pipeline:
        (top / "corpus_pipeline.py").unlink(missing_ok=True)
    assert counts(top) == (0, False, with_all[2])


def test_other_import_errors_are_not_hidden(tmp_path):
    top = copied(tmp_path / "repo")
    queries = top / "assayspark/llm/queries.py"
    if not queries.exists():
        pytest.skip("the optional subpackage is not there")
    queries.write_text("import no_such_module\n")
    found = subprocess.run([sys.executable, "-c", CODE], cwd=top, capture_output=True, text=True, check=False, timeout=300)
    assert "no_such_module" in found.stderr and found.returncode
