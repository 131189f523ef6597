"""The entry point, with and without the training-data part."""

import shutil
import subprocess
import sys

from conftest import ROOT, SF

CODE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q) and "latest_state" in q
print("LLM", any(n.startswith("op1_") for n in q), "pipeline" in q)
"""


def run(folder):
    return subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"})


def test_entry_returns_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_without_the_optional_part(tmp_path):
    for p in ("tidelog", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "tidelog" / "llm", ignore_errors=True)
    found = run(tmp_path)
    assert found.returncode == 0, found.stderr
    assert "LLM False False" in found.stdout


def test_nothing_else_imports_the_optional_part():
    for p in (ROOT / "tidelog").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
    assert SF
