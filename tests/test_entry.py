"""The entry points without the part that may be absent."""

import subprocess
import sys
from pathlib import Path

from glosswork.catalog.queries import QUERIES

SCRIPT = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {hidden!r} or name in {hidden!r}:
            raise ImportError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
print(*sorted(entry.queries()), "|", *sorted(entry.oracle_sql()))
"""


def listed(hidden):
    root = str(Path(__file__).resolve().parent.parent)
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(hidden=hidden)], cwd=root, capture_output=True, text=True, check=True)
    queries, oracle = run.stdout.strip().split("|")
    return set(queries.split()), set(oracle.split())


def test_other_queries_are_listed_without_tokenizers_or_operators():
    for hidden in (["public_tokenizers"], ["glosswork.llm"], ["corpus_pipeline", "glosswork.llm"]):
        assert listed(hidden) == (set(QUERIES), set(QUERIES))
    queries, _ = listed(["corpus_pipeline"])
    assert queries >= set(QUERIES) and "pipeline" not in queries
