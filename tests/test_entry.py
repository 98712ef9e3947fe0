"""The driver's contract."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["decl_id", "name", "kind", "file", "line", "message"]
    assert df.count() > 0


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_stands_without_the_subpackage(tmp_path, pipeline):
    """With the subpackage gone, and the pipeline's file gone or left, everything else imports."""
    here = Path(entry.__file__).parent
    shutil.copytree(here, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for part in ("fathom/llm", "tests/llm"):
        shutil.rmtree(tmp_path / "r" / part, ignore_errors=True)
    if not pipeline:
        (tmp_path / "r" / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q); assert not [k for k in q if k.startswith('op') or k == 'pipeline']"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
