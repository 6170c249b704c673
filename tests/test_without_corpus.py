"""The library and the entry work when the corpus subpackage, its tests and its pipeline are gone."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_corpus(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py")
    shutil.copytree(ROOT, tmp_path / "r", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and all(n.startswith('das_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "r")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env, check=True)
    rest = [sys.executable, "-m", "pytest", "-q", "-x", "tests/test_design.py", "tests/test_records.py", "-p", "no:cacheprovider"]
    subprocess.run(rest, cwd=tmp_path / "r", env=env, check=True)


def test_a_missing_dependency_is_no_missing_subpackage(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "r", ignore=skip)
    package = tmp_path / "r" / "lumenspan" / "llm"
    package.mkdir(exist_ok=True)
    (package / "__init__.py").write_text("")
    (package / "queries.py").write_text("import a_module_that_is_not_there\n")
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "r")}
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "r", env=env, capture_output=True, text=True)
    assert done.returncode and "a_module_that_is_not_there" in done.stderr
