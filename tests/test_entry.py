"""The driver's contract, with and without the training-data subpackage."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_without_llm(tmp_path):
    for x in ("tessera", "__spark_entry__.py"):
        at = ROOT / x
        shutil.copytree(at, tmp_path / x, ignore=shutil.ignore_patterns("llm", "__pycache__")) if at.is_dir() else shutil.copy(at, tmp_path / x)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op') or n == 'pipeline'], q.keys(); print(len(q))"
    r = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr


def test_core_imports_nothing_of_llm():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(from|import)\s+tessera\.llm|from \.+llm", p.read_text()), p


def test_no_local_checkpoints():
    for p in [*(ROOT / "tessera").rglob("*.py"), *ROOT.glob("*.py")]:
        assert "localCheckpoint" not in p.read_text(), p


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
