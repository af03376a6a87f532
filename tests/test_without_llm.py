"""The rest of the library works without the llm package."""

import subprocess
import sys

CODE = """
import sys
sys.modules['foliospark.llm'] = None
import __spark_entry__ as e
names = e.queries()
assert names and not any(n.startswith('op') or n == 'pipeline' for n in names), names
assert e.oracle_sql()
"""


def test_entry_imports_without_llm():
    subprocess.run([sys.executable, "-c", CODE], check=True, timeout=120)
