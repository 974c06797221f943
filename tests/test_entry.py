from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 48


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_nothing_else_needs_the_text_operators(tmp_path):
    """The entry point and all other modules import without the text operators."""
    import shutil

    for name in ("sievecraft", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "sievecraft" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e, sievecraft.engine, sievecraft.cli, sievecraft.streaming.ingest; assert not [k for k in e.queries() if k[:2] == 'op'], e.queries(); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)
    assert done.returncode == 0, done.stderr
