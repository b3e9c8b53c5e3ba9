"""The driver's contract without a session."""

import subprocess
import sys
from pathlib import Path


def test_queries_are_listed_before_a_session_exists():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 100; print('listed')"
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=300)
    assert run.stdout.endswith("listed\n"), run.stderr
