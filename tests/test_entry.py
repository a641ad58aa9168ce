"""The entry module without the optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parents[1]


@pytest.mark.parametrize("gone", [("docloom/llm",), ("corpus_pipeline.py",), ("docloom/llm", "corpus_pipeline.py")])
def test_imports_without_optional_parts(tmp_path, gone):
    shutil.copytree(REPO / "docloom", tmp_path / "docloom", ignore=shutil.ignore_patterns("__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / f).exists():
            shutil.copy(REPO / f, tmp_path)
    for g in gone:
        at = tmp_path / g
        if at.is_dir():
            shutil.rmtree(at)
        else:
            at.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rrf_hybrid' in q and 'pipeline' not in q; e.oracle_sql(); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 80


def test_other_import_errors_show(tmp_path):
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    shutil.copytree(REPO / "docloom", tmp_path / "docloom", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert "no_such_module_at_all" in done.stderr
