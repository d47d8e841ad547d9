import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_optional_parts(tmp_path):
    import shutil

    shutil.copytree(ROOT / "attestor", tmp_path / "attestor", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and not any(x.startswith('op') and x[2].isdigit() for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
