"""The entry module without the training-data operators, as when their folders are absent."""
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("hidden", ["corpus_pipeline", "sessionsift.llm"])
def test_other_queries_without_the_llm_folders(hidden):
    code = f"""
import sys
sys.modules['{hidden}'] = None
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 60 and set(e.oracle_sql()) <= names
assert not any(n.startswith('op') or n == 'pipeline' for n in names), names
"""
    done = run(code)
    assert done.returncode == 0, done.stderr


def test_other_import_errors_are_not_swallowed():
    code = """
import sys
sys.modules['pyarrow'] = None
import __spark_entry__
"""
    done = run(code)
    assert done.returncode != 0 and "pyarrow" in done.stderr
