"""The entry points, also where the corpus operators or a library that they need are missing."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["", "tidemark.llm", "public_tokenizers", "corpus_pipeline"])
def test_entry_without(missing):
    code = f"import sys; sys.modules.update({{m: None for m in {missing!r}.split()}}); import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    from tidemark.plans import FOUND

    assert int(out[0]) >= len(FOUND) and out[1] == "True"
