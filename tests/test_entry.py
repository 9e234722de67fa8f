"""The entry module, whole and without the part for training text."""

import importlib.util
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
PROBE = """
import __spark_entry__ as e
names = e.queries()
assert "current_state" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names, sorted(names)
assert set(e.oracle_sql()) <= set(names)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0
"""


@pytest.mark.skipif(not Path(entry.SMALL).exists(), reason="no test tables")
@pytest.mark.parametrize("pipeline", [True, False])
def test_works_without_the_training_text_part(tmp_path, pipeline):
    """With both folders deleted, and with corpus_pipeline.py left behind or not."""
    copy = tmp_path / "repo"
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, copy, ignore=skip)
    (copy / "searchspark" / "llm" / "__pycache__").mkdir(parents=True)
    rest = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(copy), *(p for p in rest if p and Path(p).resolve() != ROOT)])}
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_an_import_that_fails_is_no_missing_part():
    assert entry._there("searchspark.queries") and not entry._there("searchspark.nothing") and not entry._there("nothing.at.all")
    assert importlib.util.find_spec("searchspark.queries")
