"""The driver's contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _copy(to):
    for p in ("lakequill", "tests", "__spark_entry__.py", "bench.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, to / p, **({"ignore": shutil.ignore_patterns("__pycache__")} if (ROOT / p).is_dir() else {}))
    return {"PYTHONPATH": str(to), "PATH": os.environ["PATH"], "HOME": str(to)} | {k: v for k, v in os.environ.items() if k.startswith(("JAVA", "SPARK_HOME"))}


def test_the_rest_stands_alone(tmp_path):
    """With both folders of the training-data operators deleted the queries are there and the other tests pass."""
    env = _copy(tmp_path)
    shutil.rmtree(tmp_path / "lakequill" / "llm", ignore_errors=True)
    shutil.rmtree(tmp_path / "tests" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tpch_q1' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=100, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-x", "-q", "-p", "no:cacheprovider", "--ignore", "tests/test_entry.py", "-k", "dialect or end_to_end or tpch or plan"], cwd=tmp_path, check=True, timeout=600, env=env)


def test_a_missing_library_of_the_training_operators_costs_only_these(tmp_path):
    env = _copy(tmp_path)
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'tpch_q1' in q and 'pipeline' not in q and set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=100, env=env)
