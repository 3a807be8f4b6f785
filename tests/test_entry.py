"""The driver's contract without the corpus operators, and with broken ones."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def copy(tmp_path):
    """The library without the corpus operators and the pipeline."""
    shutil.copytree(os.path.join(ROOT, "maskwright"), tmp_path / "maskwright", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    return tmp_path


def run(where):
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    return subprocess.run([sys.executable, "-c", code], cwd=where, capture_output=True, text=True, timeout=120)


def test_the_rest_imports_without_the_corpus_operators(copy):
    n, ops, told = run(copy).stdout.split()
    assert int(n) > 70 and int(ops) < 2 and told == "True"


def test_a_broken_import_in_them_is_an_error(copy):
    (copy / "maskwright" / "llm").mkdir()
    (copy / "maskwright" / "llm" / "__init__.py").write_text("")
    (copy / "maskwright" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    done = run(copy)
    assert done.returncode != 0 and "a_module_that_is_not_there" in done.stderr
