"""The entry point with and without the optional training-text package."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from spendlens.plans.catalog import QUERIES
from tests.test_oracles import WITHOUT_SQL

ROOT = Path(entry.__file__).parent
CODE = "import __spark_entry__ as e; import tests.compare, bench; print(len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline", [False, True])
def test_imports_without_the_training_text_package(tmp_path, pipeline):
    away = shutil.ignore_patterns("llm", ".*", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=away)
    made = subprocess.run([sys.executable, "-c", CODE], cwd=copy, capture_output=True, text=True, check=False)
    assert made.returncode == 0, made.stderr
    assert made.stdout.split() == [str(len(QUERIES)), str(len(QUERIES) - len(WITHOUT_SQL))]

