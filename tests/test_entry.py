"""The entry module in a process of its own."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert o.keys() <= q.keys() and len(q) > 60 - 12 and 'giant_component' in o; print(len(q))"
    found = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
