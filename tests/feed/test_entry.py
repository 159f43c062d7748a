"""The driver's contract without what is optional."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys, warnings
for name in {missing}:
    sys.modules[name] = None  # its import fails
warnings.simplefilter("ignore")
import __spark_entry__ as entry
from tidelog.plans import catalog
assert set(entry.queries()) >= set(catalog.QUERIES) and set(entry.oracle_sql()) >= set(catalog.ORACLE_SQL)
assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
print(len(set(entry.queries()) - set(catalog.QUERIES)))
"""


def others(*missing: str) -> int:
    run = subprocess.run([sys.executable, "-c", CODE.format(missing=missing)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return int(run.stdout)


def test_a_missing_library_leaves_the_feed():
    assert others("zstandard") == others("numpy") == 0
