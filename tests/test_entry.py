"""The driver's contract, with and without the optional parts."""

import subprocess
import sys

import __spark_entry__ as entry
import pytest
from conftest import ROOT


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and len(names) >= 50


@pytest.mark.parametrize("parts", [["__spark_entry__.py"], ["__spark_entry__.py", "corpus_pipeline.py"]])
def test_imports_without_optional_parts(tmp_path, parts):
    import shutil

    shutil.copytree(ROOT / "quillmill", tmp_path / "quillmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for part in parts:
        if (ROOT / part).exists():  # the pipeline may be gone along with its operators
            shutil.copy(ROOT / part, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'language_chunks' in q and 'pipeline' not in q; print('fine')"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.stdout.strip() == "fine", done.stderr
