"""Every registered query with SQL against DuckDB, the others for rows and invariants."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest
from compare import DATA, assert_same

from veinstone.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert_same(spark, name, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["a", "b", "n_shared"]
    assert set(ORACLES) <= set(QUERIES) <= set(e.queries())


def test_entry_without_the_llm_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for keep_pipeline in (True, False):
        copy = tmp_path / str(keep_pipeline)
        gone = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if keep_pipeline else ["corpus_pipeline.py"]))
        shutil.copytree(root, copy, ignore=gone)
        code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') for k in q); print(len(q))"
        # the copy comes first, then what this process inherited without the repository itself
        inherited = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != root]
        env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(copy), *inherited])}
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
        assert out.returncode == 0 and int(out.stdout) == len(QUERIES), out.stderr
        out = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True)
        assert out.returncode == 0, out.stdout
