"""The entry works without the training-data subpackage, and says so."""

import subprocess
import sys
from pathlib import Path

HIDE = """
import sys
sys.modules[{hidden!r}] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert not any(n.startswith("op") for n in names) and "pipeline" not in names and "pii_mask" in names
assert set(entry.oracle_sql()) <= names
"""


def test_without_the_subpackage():
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", HIDE.format(hidden="textward.llm")], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert "training-data queries left out" in done.stderr
