"""The entry without the training-data subpackage, which may be left out."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_imports_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "changelens", tmp_path / "changelens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert re.fullmatch(r"\d\d+ False True\n", said.stdout), said.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "changelens").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"import.*\bllm\b|from .*\bllm\b", path.read_text()), path
