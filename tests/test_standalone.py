"""Without the training-data package the rest imports and has its queries."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "rigspark", tmp_path / "rigspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lidar_scan_summary' in q and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for path in (ROOT / "rigspark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "rigspark").parts:
            assert "llm" not in path.read_text()
