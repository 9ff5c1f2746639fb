"""The other queries work where the training-data subpackage cannot be imported."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
BLOCKED = """
import sys, warnings
warnings.simplefilter("ignore")
sys.modules[{module!r}] = None
import __spark_entry__ as entry
assert entry.LLM is None and len(entry.queries()) >= 140 and set(entry.queries()) == set(entry.oracle_sql())
"""


def test_queries_without_the_subpackage_or_a_library():
    for module in ("wardline.llm", "xxhash", "corpus_pipeline"):
        done = subprocess.run([sys.executable, "-c", BLOCKED.format(module=module)], cwd=ROOT, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
