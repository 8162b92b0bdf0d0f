import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]

PROBE = """
import sys

class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {blocked!r} or name in {blocked!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Absent())
import __spark_entry__ as driver
from irregts.plans.queries import QUERIES
assert set(driver.queries()) == set(QUERIES) and set(driver.oracle_sql()) <= set(QUERIES), "other queries"
print(len(QUERIES))
"""


@pytest.mark.parametrize("blocked", ["xxhash", "public_tokenizers", "ahocorasick", "corpus_pipeline", "irregts.llm"])
def test_other_queries_load_without_the_training_data_part(blocked):
    code = PROBE.format(blocked=[blocked])
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and int(done.stdout) > 90, done.stderr[-800:]
