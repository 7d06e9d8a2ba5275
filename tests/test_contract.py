"""The contract stands without the operators for training text."""

import subprocess
import sys
from pathlib import Path

HOME = Path(__file__).resolve().parents[1]
WITHOUT = """
import sys

class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("opinionloom.llm"):
            raise ModuleNotFoundError(name, name=name)

sys.meta_path.insert(0, Absent())
import __spark_entry__ as contract
names, twins = contract.queries(), contract.oracle_sql()
assert len(names) > 60 and set(twins) <= set(names)
assert not [n for n in names if n.startswith("op") or n == "pipeline"]
"""


def test_entry_imports_without_them():
    done = subprocess.run([sys.executable, "-c", WITHOUT], cwd=HOME, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_them():
    for file in (HOME / "opinionloom").rglob("*.py"):
        if "llm" not in file.parts:
            assert "opinionloom.llm" not in file.read_text(), file
