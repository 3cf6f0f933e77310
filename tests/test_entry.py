"""The driver's entry without the optional corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("gone", [("colligo/llm", "corpus_pipeline.py"), ("colligo/llm",)])
def test_entry_without_corpus_operators(tmp_path, gone):
    for name in ("colligo", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", *(g.split("/")[1] for g in gone if "/" in g)))
        elif name not in gone and os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) > 50 and out[1:] == ["False", "False", "True"]
