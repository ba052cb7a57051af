"""The entry module without what the training-data operators need."""

import subprocess
import sys

import pytest

from conftest import ROOT


@pytest.mark.parametrize("missing", ["corpus_pipeline", "roverlake.llm", "public_tokenizers"])
def test_entry_without(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; names = e.queries(); assert len(names) >= 55 and set(e.oracle_sql()) <= set(names) and not any(n.startswith('op') and n[2].isdigit() for n in names)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
