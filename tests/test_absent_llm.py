"""The engine works without the training-data subpackage and the pipeline module."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(f"{HERE}/sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=False)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 40


def test_a_missing_library_is_no_absence(tmp_path):
    """Only the subpackage itself may be missing: an import error inside it shows."""
    shutil.copytree(f"{HERE}/sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    (tmp_path / "sparkloom/llm").mkdir()
    (tmp_path / "sparkloom/llm/__init__.py").write_text("")
    (tmp_path / "sparkloom/llm/queries.py").write_text("import no_such_library")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=False)
    assert out.returncode != 0 and "no_such_library" in out.stderr


def test_remaining_tests_without_the_subpackage(tmp_path):
    for name in ("sparkloom", "tests"):
        shutil.copytree(f"{HERE}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    shutil.copy(f"{HERE}/bench.py", tmp_path)
    command = [sys.executable, "-m", "pytest", "-q", "-x", "tests/test_functions.py", "tests/test_sources.py", "-p", "no:cacheprovider"]
    out = subprocess.run(command, cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=False)
    assert out.returncode == 0, out.stdout[-2000:]
    assert subprocess.run([sys.executable, "-c", "import bench"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, check=False).returncode == 0
