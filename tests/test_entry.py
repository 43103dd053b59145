"""The driver's entry where the training-data operators, or what they need, are missing."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["public_tokenizers", "xxhash", "regex", "quillspan.llm", "corpus_pipeline"])
def test_entry_survives(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; from quillspan.plans import registry; assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries()); print(len(registry.QUERIES))"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) > 140, done.stderr
