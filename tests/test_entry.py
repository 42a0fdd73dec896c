import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_optional_packages():
    """Whatever the training-data part imports may be absent: the other queries stay."""
    code = """
import sys
for name in ("public_tokenizers", "xxhash", "regex", "tokenizers"):
    sys.modules[name] = None
import warnings
warnings.simplefilter("ignore")
import __spark_entry__ as e
from loomdex.plans import queries
assert set(queries.QUERIES) <= set(e.queries()) and len(queries.QUERIES) >= 49
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=120)
