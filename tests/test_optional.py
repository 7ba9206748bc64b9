"""The rest works without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_import_without_optional_parts(tmp_path):
    shutil.copytree(ROOT / "verbatlas", tmp_path / "verbatlas", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'verb_lemma_counts' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_nothing_else_uses_the_optional_package():
    for f in (ROOT / "verbatlas").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "verbatlas").parts:
            assert "verbatlas.llm" not in f.read_text(), f
